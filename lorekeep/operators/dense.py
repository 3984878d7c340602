"""RET-2: dense retrieval: exact top-k by cosine in blocks, or by random-projection buckets.

A stored index is in ``vector_index``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .lexical import top_k

#: Vectors of a block, of queries or of those searched; pairs of blocks are multiplied.
BLOCK = 4096
#: Query blocks are broadcast so many bytes at a time; a larger batch takes several scans of the vectors.
BROADCAST = 64 << 20
#: Cosines are compared to nine decimals, so that equal ones tie on any machine.
DECIMALS = 9


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def blocks(vectors: DataFrame, id_col: str, prefix: str, provider: Callable | None = None, group: str | None = None) -> DataFrame:
    """Vectors (id, vec) as rows of up to BLOCK vectors of one length: ids, length, matrix.
    With a ``provider``, (id, text), and texts are embedded on the way.  With a ``group``
    (a column of whole numbers), blocks also are of one group."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def row(key: tuple[int, int]) -> pa.RecordBatch:
            ids, parts = zip(*held.pop(key), strict=True)
            cols = [pa.array([np.concatenate(ids)], pa.list_(pa.int64())), pa.array([key[1]], pa.int32()), pa.array([np.concatenate(parts).tobytes()], pa.binary()), pa.array([key[0]], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=[f"{prefix}_ids", f"{prefix}_dim", f"{prefix}_matrix", f"{prefix}_group"])

        for b in batches:
            ids = b.column(id_col).to_numpy()
            groups = b.column(group).to_numpy() if group else np.zeros(len(ids), np.int64)
            for rows, matrix in _matrices(b, provider):
                for g in np.unique(groups[rows]).tolist():
                    own = np.flatnonzero(groups[rows] == g)
                    key = (g, matrix.shape[1])
                    for a in range(0, len(own), BLOCK):
                        part = own[a : a + BLOCK]
                        held.setdefault(key, []).append((ids[rows[part]], matrix[part]))
                        if sum(len(x) for x, _ in held[key]) >= BLOCK:
                            yield row(key)
        for key in list(held):
            yield row(key)

    what = "text" if provider else "vec"
    cols = [id_col, what, *([group] if group else [])]
    return vectors.select(*cols).filter(F.col(what).isNotNull()).mapInArrow(pack, f"{prefix}_ids array<long>, {prefix}_dim int, {prefix}_matrix binary, {prefix}_group long")


def _matrices(b: pa.RecordBatch, provider: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a batch: the vectors of each length."""
    if provider:
        yield np.arange(len(b)), np.asarray(provider(b.column("text").to_pylist()))
        return
    lists = b.column("vec")
    at = lists.offsets.to_numpy()
    flat, at, sizes = lists.flatten().to_numpy(zero_copy_only=False), at - at[0], np.diff(at)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, flat[at[rows][:, None] + np.arange(dim)]


def nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row, the lesser id first of equals."""
    k = min(k, scores.shape[1])
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(scores >= least)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    some = np.arange(len(row)) - first[row] < k
    return row[some], col[some]


def _matrix(held: pa.BinaryScalar, rows: int, dim: int) -> np.ndarray:
    """The vectors of a block, which are floats or doubles as their column was."""
    raw = held.as_buffer()
    return np.frombuffer(raw, np.float32 if raw.size == 4 * rows * dim else np.float64).reshape(rows, dim).astype(np.float64)


def _scored(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(len(b)):
            dim = b.column("q_dim")[i].as_py()
            qid, vid = (b.column(c)[i].values.to_numpy() for c in ("q_ids", "v_ids"))
            q, v = (_unit(_matrix(b.column(c)[i], len(ids), dim)) for c, ids in (("q_matrix", qid), ("v_matrix", vid)))
            scores = np.round(q @ v.T, DECIMALS)
            row, col = nearest(scores, vid, k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[row], vid[col], scores[row, col])], names=["query_id", "vec_id", "score"])


def scored_blocks(q: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): at most k a query and pair of blocks of one length and group.

    Query blocks go to the vectors, which stay where they are.  They are
    stored and sized first: up to BROADCAST bytes are broadcast at once, what
    is more in further rounds, each a scan of the vectors."""
    q = stored(q, "query-blocks")
    size = q.agg(F.coalesce(F.sum(F.octet_length("q_matrix")), F.lit(0))).first()[0]
    rounds = -(-size // BROADCAST) or 1
    dealt = q.withColumn("_round", F.pmod(F.xxhash64("q_ids"), F.lit(rounds)))
    out = None
    for i in range(rounds):
        part = F.broadcast(dealt.filter(F.col("_round") == i).drop("_round"))
        pairs = v.join(part, (F.col("q_dim") == F.col("v_dim")) & (F.col("q_group") == F.col("v_group")))
        one = pairs.mapInArrow(lambda it: _scored(it, k), "query_id long, vec_id long, score double")
        out = one if out is None else out.unionByName(one)
    return out


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 20, provider: Callable | None = None) -> DataFrame:
    """(query_id, vec_id, score, pos): the k vectors of largest cosine a query.

    ``queries``: query_id, vec; ``vectors``: vec_id, vec; or, with an embedding
    ``provider`` (texts -> vectors of one length), text in place of vec.  Both go through as
    blocks of bounded size: every block of queries is broadcast (see
    ``scored_blocks``) and multiplied with every block of vectors where that
    is; k rows a query and pair of blocks are shuffled.  Vectors are never
    shuffled.  Vectors of another length than the query's are left out; equal
    scores go by vec_id.
    """
    q, v = blocks(queries, "query_id", "q", provider), blocks(vectors, "vec_id", "v", provider)
    return top_k(scored_blocks(q, v, k), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def lsh_search(queries: DataFrame, vectors: DataFrame, dim: int, k: int = 20, tables: int = 24, bits: int = 10, seed: int = 11) -> DataFrame:
    """Approximate form: vectors that agree with a query in a table's sign bits
    are scored exactly.  An extension; recall depends on ``tables`` and ``bits``."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))

    @F.pandas_udf("array<int>")
    def buckets(s):
        import pandas as pd

        weights = 1 << np.arange(bits)
        v = np.stack([np.asarray(x, np.float64) for x in s])
        signs = (v @ planes.T > 0).reshape(len(v), tables, bits)
        return pd.Series(list((signs * weights).sum(axis=2).astype(np.int32)), dtype=object)

    from ..functions.vectors import cosine

    q = queries.select("query_id", F.col("vec").alias("qv"), F.posexplode(buckets("vec")).alias("t", "b"))
    v = vectors.select("vec_id", F.posexplode(buckets("vec")).alias("t", "b"))
    pairs = q.join(v, ["t", "b"]).select("query_id", "vec_id", "qv").dropDuplicates(["query_id", "vec_id"])
    scored = pairs.join(vectors.select("vec_id", "vec"), "vec_id").select("query_id", "vec_id", cosine(F.col("qv"), F.col("vec")).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
