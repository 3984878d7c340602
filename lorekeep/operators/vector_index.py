"""RET-2, SNK-14: a stored vector index: lists around coarse centroids, exact scores inside them.

Every vector is in the list of its nearest centroid.  A query is scored
exactly against the vectors of its nearest lists, so a search reads those
lists' files only.  How many lists are read is found at build time by
measuring recall against a full search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from .dense import _matrices, _unit, blocks, dense_search, scored_blocks
from .lexical import top_k

#: About sqrt(rows) lists, at most so many.
MOST_LISTS = 4096
#: Centroids are fitted on a hash sample of at most about so many vectors a list, and so many bytes.
FIT_A_LIST, FIT_BYTES = 64, 256 << 20
#: Vectors of a file; a list with more has several, so that a hot list is read by several tasks.
FILE_ROWS = 200_000
#: Queries (a hash sample of the rows) on which recall is measured, and the recall asked for.
TUNE_QUERIES, RECALL = 200, 0.95


@dataclass(frozen=True)
class VectorIndex:
    """An index under ``path``: its centroids (a row each) and the lists a query reads."""

    path: str
    centroids: np.ndarray
    probes: int
    k: int
    recall: float  # measured at build, with these probes
    kind: str = "array<float>"  # of the vectors

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"vec_id long, vec {self.kind}, list int").parquet(f"{self.path}/lists")


def _centroids(sample: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by Lloyd's steps on the sphere; an empty one moves to the vector that fits worst."""
    rng = np.random.default_rng(seed)
    x = _unit(sample)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = x @ c.T
        at, best = own.argmax(axis=1), own.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        empty = np.flatnonzero(np.bincount(at, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(best)[: len(empty)]]
        c = _unit(sums)
    return c


def nearest_lists(vectors: DataFrame, id_col: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(id, vec, list, at): each vector with its ``probes`` nearest lists, the nearest at 0.  Zero vectors go to the first lists;
    vectors of another length than the centroids' are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_LISTS rows
    kind = vectors.schema["vec"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n = min(probes, len(c))
        for b in batches:
            for rows, matrix in _matrices(b, None):
                if matrix.shape[1] != c.shape[1] or not n:
                    continue
                near = np.argsort(-(_unit(matrix.astype(np.float64)) @ c.T), axis=1, kind="stable")[:, :n]
                again = pa.array(np.repeat(rows, n))
                yield pa.RecordBatch.from_arrays([b.column(id_col).take(again), b.column("vec").take(again), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(rows)))], names=[id_col, "vec", "list", "at"])

    return vectors.select(id_col, "vec").filter(F.col("vec").isNotNull()).mapInArrow(assign, f"{id_col} long, vec {kind}, list int, at int")


def build(vectors: DataFrame, path: str, k: int = 10, lists: int | None = None, probes: int | None = None, seed: int = 7) -> VectorIndex:
    """Writes an index of all vectors (vec_id, vec) of the most common length and returns it.

    Only centroids are fitted on a (hash) sample of documented size; every
    vector is in the index.  Without ``probes``, the fewest lists are chosen
    with which the measured recall at k is RECALL."""
    spark = vectors.sparkSession
    known = vectors.select("vec_id", "vec").filter("vec IS NOT NULL AND size(vec) > 0")
    common = known.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (common["dim"], common["n"]) if common else (0, 0)
    lists = min(MOST_LISTS, max(1, int(n**0.5))) if lists is None else lists
    known = known.filter(F.size("vec") == dim)
    draw = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    most = min(FIT_A_LIST * lists, FIT_BYTES // (8 * max(1, dim)))
    fit = [np.asarray(r["vec"], np.float64) for r in known.filter(draw < most / max(1, n)).select("vec").toLocalIterator()]
    c = _centroids(np.stack(fit), lists, seed) if fit else np.empty((0, dim))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // FILE_ROWS)))
    nearest_lists(known, "vec_id", c, 1).drop("at").repartition("list", spread).write.mode("errorifexists").partitionBy("list").parquet(f"{path}/lists")
    made = VectorIndex(path, c, probes or max(1, len(c)), k, 1.0, known.schema["vec"].dataType.simpleString())
    if probes is None and len(c):
        ask = known.filter(draw < TUNE_QUERIES / max(1, n)).select(F.col("vec_id").alias("query_id"), "vec")
        made = tuned(made, ask, dense_search(ask, known, k))
    about = {"centroids": made.centroids.tolist(), "dim": dim, "probes": made.probes, "k": k, "recall": made.recall, "kind": made.kind}
    sinks.replace_file(spark, f"{path}/about.json", json.dumps(about))
    return made


def tuned(index: VectorIndex, queries: DataFrame, exact: DataFrame) -> VectorIndex:
    """The index with the fewest probes whose recall on these queries is RECALL.

    For each true neighbour, the rank of its list among the query's lists says
    from how many probes on it is found; recall follows for every number at once."""
    spark = queries.sparkSession
    ranked = nearest_lists(queries, "query_id", index.centroids, len(index.centroids)).select("query_id", "list", "at")
    homes = index.rows(spark).select("vec_id", "list")
    found = exact.select("query_id", "vec_id").join(homes, "vec_id").join(ranked, ["query_id", "list"])
    counts = {r["at"]: r["n"] for r in found.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list at most
    total, seen = sum(counts.values()), 0
    for at in range(len(index.centroids)):
        seen += counts.get(at, 0)
        if seen >= RECALL * total:
            return replace(index, probes=at + 1, recall=seen / total if total else 1.0)
    return index


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was written before."""
    a = json.loads(spark.read.text(f"{path}/about.json", wholetext=True).first()[0])
    return VectorIndex(path, np.array(a["centroids"], np.float64).reshape(-1, a["dim"]), a["probes"], a["k"], a["recall"], a["kind"])


def search(queries: DataFrame, index: VectorIndex, k: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, pos) of queries (query_id, vec): exact cosines over their nearest lists.

    The scan is pruned to lists that some query asks for.  Query blocks are
    made a list and broadcast under a checked size; vectors are not shuffled."""
    spark = queries.sparkSession
    asked = nearest_lists(queries, "query_id", index.centroids, probes or index.probes)
    lists = sorted(r["list"] for r in asked.select("list").distinct().collect())  # at most MOST_LISTS
    vectors = index.rows(spark).filter(F.col("list").isin(lists))
    q, v = (blocks(d.withColumn("list", F.col("list").cast("long")), i, p, group="list") for d, i, p in ((asked, "query_id", "q"), (vectors, "vec_id", "v")))
    k = k or index.k
    return top_k(scored_blocks(q, v, k), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
