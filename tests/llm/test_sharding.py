from __future__ import annotations

import time
import zlib

import numpy as np

from lorekeep.llm.sharding import communication_matrix, shard_rows, sharded

from .util import ODD, docs


def test_matrix_sums():
    m = communication_matrix([5, 0, 17, 3], [9, 8, 8], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and m.sum(axis=0).tolist() == [9, 8, 8] and (m >= 0).all()


def test_large_populations_have_the_law():
    """Draws have the hypergeometric law, as one block or as the first of two, and work for large populations."""
    for counts in ([60], [60, 140]):
        x = [communication_matrix(counts, [30, 40, 130], seed)[0] for seed in range(3000)]
        assert np.abs(np.mean(x, axis=0) - np.array([9, 12, 39])).max() < 0.25
        want = 60 * (200 - 60) / 199 * np.array([0.15 * 0.85, 0.2 * 0.8, 0.65 * 0.35])
        assert np.abs(np.var(x, axis=0) / want - 1).max() < 0.12
    m = communication_matrix([1000, 2000], [10**9, 3 * 10**9, 1], 3)
    assert m.sum(axis=1).tolist() == [1000, 2000] and abs(m[:, 0].sum() - 750) < 150


def test_ten_billion_rows_take_seconds():
    began = time.monotonic()
    places = [10**10 // 24 + (j < 10**10 % 24) for j in range(24)]
    counts = [10**10 // 4096 + (b < 10**10 % 4096) for b in range(4096)]
    m = communication_matrix(counts, places, 5)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == places and (m >= 0).all()
    want = np.outer(counts, places) / 1e10
    assert abs(((m - want) ** 2 / want).sum() / (4095 * 23) - 1) < 0.03  # chi-square over its degrees of freedom
    assert time.monotonic() - began < 30


def test_deal_follows_the_matrix(spark):
    """The rows of each block that are sent to each shard are as many as the matrix says: all of it computed again."""
    texts = [f"t{i}" for i in range(500)]
    df = docs(spark, texts)
    blocks = 22  # the root of 500
    block = {r.doc_id: r.b for r in df.selectExpr("doc_id", f"CAST(pmod(xxhash64(doc_id, crc32(CAST(text AS BINARY))), {blocks}) AS INT) AS b").collect()}
    got = {r.doc_id: r.shard for r in shard_rows(df, shards=6, seed=3).collect()}
    counts = np.bincount(list(block.values()), minlength=blocks)
    m = communication_matrix(counts.tolist(), [84, 84, 83, 83, 83, 83], 3)
    sent = np.zeros_like(m)
    for i, s in got.items():
        sent[block[i], s] += 1
    assert (sent == m).all()


def test_uniform():
    """Each row is as likely in each shard: chi-square over many seeds."""
    counts = np.zeros((3, 4))
    for seed in range(400):
        counts += communication_matrix([4, 6, 2], [3, 3, 3, 3], seed)
    want = np.outer([4, 6, 2], [0.25] * 4) * 400
    assert ((counts - want) ** 2 / want).sum() < 40


def test_shards_are_exact_and_gapless(spark):
    texts = (ODD * 40)[:391]
    df = docs(spark, texts).withColumnRenamed("n_chars", "shard")
    got = shard_rows(df, keep=["shard", "lang"]).toPandas()
    assert got.columns.tolist() == ["doc_id", "size", "text_crc32", "shard", "slot", "_shard", "lang"]
    got = shard_rows(docs(spark, texts)).toPandas()
    assert sorted(got["doc_id"]) == list(range(391))
    sizes = got.groupby("shard")["slot"].agg(list)
    assert len(sizes) == 24 and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in sizes)
    for r in got.itertuples():
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
    again = shard_rows(docs(spark, texts).repartition(7)).toPandas()
    assert got.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()


def test_repeated_null_and_empty(spark):
    df = docs(spark, ["t"] * 50 + [None] * 9, ids=[1] * 50 + [None] * 9)
    got = shard_rows(df, shards=4).toPandas()
    assert got.groupby("shard").size().tolist() == [15, 15, 15, 14]
    assert shard_rows(df.limit(0)).count() == 0


def test_columns_that_clash(spark):
    df = docs(spark, ["a b", "c", None]).selectExpr("doc_id", "text", "1 AS size", "2 AS slot", "3 AS shard", "4 AS c1", "source AS whole")
    got = sharded(df, shards=2)
    assert got.columns == [*df.columns, "_shard", "_slot"]
    assert sorted((r.doc_id, r.text, r.size, r.slot, r.shard, r.c1) for r in got.collect()) == [(0, "a b", 1, 2, 3, 4), (1, "c", 1, 2, 3, 4), (2, None, 1, 2, 3, 4)]
