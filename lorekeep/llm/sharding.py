"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows form blocks.  How many rows of each block go to each shard is drawn
   exactly: multivariate hypergeometric draws that split the shards' places
   between halves of the blocks, down to single ones.  The matrix so has exact row and column sums and the
   law that a uniform permutation of all rows would give it.
2. Rows of a block are permuted locally and dealt out by the block's counts.
3. Rows are exchanged, and permuted again in their shard, which gives slots.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import fresh, running, stored, unit

SHARDS = 24
#: The matrix has at most so many rows (65,536 x 24 counts are 13 MB).
MAX_BLOCKS = 65_536


def drawn_places(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows each shard gets if they take distinct places at
    random: the hypergeometric law by its definition.  Places taken twice are
    drawn again, so time and memory go with n alone."""
    ends = np.cumsum(places)
    taken = np.empty(0, np.int64)
    while len(taken) < n:
        taken = np.unique(np.concatenate([taken, rng.integers(0, ends[-1], n - len(taken))]))
    return np.bincount(np.searchsorted(ends, taken, side="right"), minlength=len(ends))


def drawn(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of n of all places, at any population up to 64 bits.

    Every place is taken with chance n / all, which is a binomial draw a shard.
    Given how many they are, the places taken are a uniform choice; so if they
    are some too many, as many are given back at random, and if too few, as many
    of the rest are taken.  That is about sqrt(n) single draws, whatever n is."""
    total = int(places.sum())
    if n in (0, total):
        return places * 0 if n == 0 else places.copy()
    if 2 * n > total:  # few are left: draw those
        return places - drawn(rng, places, total - n)
    got = rng.binomial(places, n / total)
    over = int(got.sum()) - n
    return got - drawn_places(rng, got, over) if over > 0 else got + drawn_places(rng, places - got, -over)


def communication_matrix(counts: Sequence[int], places: Sequence[int], seed: int) -> np.ndarray:
    """Rows to send from each block to each shard: sums are ``counts`` by row, ``places`` by column.

    The blocks are halved again and again: of the places that a run of blocks
    has, a draw says which its first half gets.  So there are two draws a
    block, and the driver's work does not go with the number of rows."""
    rng = np.random.default_rng(seed)
    before = np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    out = np.zeros((len(counts), len(places)), dtype=np.int64)
    runs = [(0, len(counts), drawn(rng, np.array(places, dtype=np.int64), int(before[-1])))]  # all places, if they are as many as rows
    while runs:
        low, high, own = runs.pop()
        if high - low == 1:
            out[low] = own
        elif high > low:
            middle = (low + high) // 2
            first = drawn(rng, own, int(before[middle] - before[low]))
            runs += [(low, middle, first), (middle, high, own - first)]
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), seed: int = 7, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Every row of docs with its ``shard`` (0..shards-1) and ``slot``.

    Returns the id, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``,
    ``shard``, ``slot`` (gapless from 0 in each shard) and the columns in
    ``keep``; one of those that has the name of another column returned gets
    an underscore in front.  Shard counts are at most one apart (law
    ``rows``); equal texts are rows like any others and are spread as the
    shuffle falls.

    Blocks are cut by a hash of id and text, sqrt(rows) of them, up to
    ``max_blocks``: a rerun of a lost task sees the same block.  Slots come
    from a running count over buckets of a shard, so no task holds a shard.
    Null text: 8 bytes, crc 0.  Null or repeated ids are rows like any other;
    rows equal in all columns are interchangeable.  Texts of any length.
    Empty table: no rows.

    Places are found on slim rows (ids, sizes and hashes), which are made by
    one pass over the texts and stored; other columns are joined to them at
    the end, so texts move once.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    id_ = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(
        docs[id_col].alias("id"),
        F.coalesce(docs[id_col].cast("string"), F.lit("null")).alias("idk"),
        F.crc32(text.cast("binary")).alias("crc"),
        (F.xxhash64(*[docs[c] for c in keep]) if keep else F.lit(0).cast("long")).alias("h"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        *[F.md5(F.concat_ws(":", F.lit(f"{seed}{x}"), id_, F.xxhash64(text, *[docs[c] for c in keep]).cast("string"))).alias(n) for x, n in (("a", "key"), ("b", "key2"))],
        *[docs[c].alias(n) for c, n in zip(keep, names, strict=True)],
    )
    slim = stored(rows.drop(*names), "slim")
    total = slim.count()
    blocks = max(1, min(max_blocks, math.isqrt(total)))
    block = F.pmod(F.xxhash64("id", "crc"), F.lit(blocks)).cast("int").alias("block")
    counts = {r[0]: r[1] for r in slim.groupBy(block).agg(F.count(F.lit(1)).alias("n")).collect()}
    places = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], places, seed).cumsum(axis=1)
    edges = docs.sparkSession.createDataFrame([(b, m) for b, m in enumerate(matrix.tolist())], "b int, edges array<long>")
    local = Window.partitionBy("block").orderBy("key", "crc", "h")
    dealt = slim.withColumn("block", block).withColumn("rank", F.row_number().over(local) - 1)
    dealt = dealt.join(edges, dealt["block"] == edges["b"]).withColumn("shard", F.size(F.filter("edges", lambda e: e <= F.col("rank"))))
    sent = stored(dealt.select("id", "idk", "crc", "h", "size", "key2", "shard").withColumn("draw", unit(F.col("key2"))), "shards")
    placed = running(sent, ["shard"], "draw", ["key2", "crc", "h"], F.lit(1).cast("long"), "slot", sent.select("shard", "draw"))
    out = [F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot"]
    if not keep:
        return placed.select(*out)
    # texts move once: one of rows that are equal in all columns, to all their places
    whole = rows.groupBy("idk", "crc", "h").agg(F.first(F.struct(*names)).alias("whole"))
    both = placed.join(whole, ["idk", "crc", "h"])
    taken = [id_col, "size", "text_crc32", "shard", "slot"]
    kept = []
    for x, c in zip(names, keep, strict=True):
        taken.append(fresh(taken, c))
        kept.append(F.col("whole")[x].alias(taken[-1]))
    return both.select(*out, *kept)


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """All rows of docs with their columns as they are, and ``shard`` and ``slot``
    (with an underscore in front where docs has such columns).  Otherwise as ``shard_rows``."""
    cols, names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(cols, names, strict=True))
    rest = [n for n in names if n != at[id_col]]
    placed = shard_rows(docs.toDF(*names), id_col=at[id_col], text_col=at[text_col], keep=rest, **params)
    own = [F.col(c).alias(fresh(cols, c)) for c in ("shard", "slot")]
    return placed.select(*[F.col(n).alias(c) for c, n in at.items()], *own)
