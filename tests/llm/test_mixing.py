from __future__ import annotations

import random

import duckdb

from lorekeep.llm.mixing import MIXING_SQL, curriculum, inverse_demand, mix
from pyspark.sql import functions as F

from .util import ODD, docs, words


def test_matches_sql_and_bounds(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.choice([1, 5, 40, 300])) for _ in range(300)] + ODD
    sources = [rng.choice(["b", "a", "a", "a", "z", None]) for _ in texts]
    df = docs(spark, texts, sources=sources)
    got = curriculum(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    documents = df.toPandas()  # noqa: F841  read by duckdb
    want = duckdb.sql(MIXING_SQL).df().sort_values("doc_id").reset_index(drop=True)
    for c in ("size", "source_size", "target", "taken"):
        assert got[c].tolist() == want[c].tolist(), c
    for i, c in enumerate(("position", "second_position")):
        mine = [round(p[i], 9) if len(p) > i else None for p in got["positions"]]
        assert mine == [None if x != x else x for x in want[c]], c
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.assign(source=sources).groupby("source", dropna=False).agg(t=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by["taken"] - by["t"]).abs() <= by["most"] / 2 + 1e-9).all()
    assert abs(by["t"].sum() - 1.5 * got["size"].sum()) < 1e-6
    assert got.equals(curriculum(df).toPandas().sort_values("doc_id").reset_index(drop=True))


def test_positions_follow_the_schedule(spark):
    s = ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))

    def demand(t):
        out = 0.0
        for (a, wa), (b, wb) in zip(s, s[1:]):
            x = min(max(t, a), b)
            w = wa + (wb - wa) * (x - a) / (b - a)
            out += (x - a) * (wa + w) / 2
        return out

    rows = spark.range(0, 101).select((F.col("id") / 100).alias("d")).select("d", inverse_demand(F.col("d"), s).alias("t")).collect()
    for r in rows:
        assert abs(demand(r.t) / demand(1.0) - r.d) < 1e-9


def test_mix_repeats_and_sorts(spark):
    df = docs(spark, ["one two three"] * 4 + ["x y"] * 4, sources=["a"] * 4 + ["b"] * 4).withColumnRenamed("n_chars", "position")
    got = mix(df)
    assert got.columns == df.columns
    counts = {}
    for r in got.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    want = {r.doc_id: r.taken // r.size for r in curriculum(df).collect() if r.taken}
    assert counts == want
    assert mix(df.limit(0)).count() == 0
