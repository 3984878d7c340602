from __future__ import annotations

import random

import corpus_pipeline
from lorekeep.llm.nearby import near_groups

from .test_langid import text
from .util import docs


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(14)
    langs = [rng.choice(["xx", "yy", "zz"]) for _ in range(120)]
    texts = [text(rng, x, 60) for x in langs]
    item = texts[7]
    texts += [texts[3], texts[3] + " x", "before " + item + " after", None, "123"]
    df = docs(spark, texts, langs=langs + ["xx"] * 5, sources=[rng.choice(["a", "b"]) for _ in texts])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == df.columns
        after.write.parquet(str(tmp_path / name.replace(" ", "_")))
        at = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen.append([r.doc_id for r in at.select("doc_id").collect()])
    lang, near, clean, mixed = seen
    assert sorted(set(range(125)) - set(lang)) == [123, 124]
    lang_docs = df.filter(df.doc_id < 123)
    assert sorted(near) == sorted({r.class_id for r in near_groups(lang_docs).collect()})
    assert set(near) - set(clean) == {7, 122} & set(near) and set(clean) <= set(near)
    assert set(mixed) <= set(clean) and max(map(mixed.count, set(mixed))) <= 2
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(got["doc_id"]) == sorted(mixed)
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and got.columns.tolist() == [*df.columns, "shard", "slot"]


def test_clashing_columns_repeats_and_empty(spark, tmp_path):
    rng = random.Random(15)
    texts = [text(rng, x, 40) for x in ("xx", "yy", "zz") * 8]
    df = docs(spark, [*texts, texts[0], None, ""], ids=[*range(24), 0, None, None], langs=["xx", "yy", "zz"] * 8 + ["xx"] * 3)
    df = df.selectExpr("*", "1 AS size", "2 AS slot", "3 AS shard", "'k' AS `key`", "4 AS position", "5 AS rep", "6 AS h", "7 AS label")
    bench = spark.createDataFrame([], "item_id long, text string")
    for name, part in (("some", df), ("none", df.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        bench.write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert got.columns == [*df.columns, "_shard", "_slot"]
    rows = got.collect()
    assert {r.doc_id for r in rows} <= set(range(24)) and all((r.size, r.slot, r.shard) == (1, 2, 3) for r in rows)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
