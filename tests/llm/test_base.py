from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.llm import base


def test_by_size_cuts_by_characters():
    texts = ["a" * 5, None, "", "b" * 7, "c" * 30, "d"]
    cuts = list(base.by_size(texts, 10))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(6))
    assert cuts == [(0, 3), (3, 4), (4, 5), (5, 6)] and list(base.by_size([], 3)) == []


def test_split_join_is_a_join(spark):
    """Also with a key of most rows, which is dealt to several pieces."""
    rows = base.stored(spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("by"), F.lit("x").alias("g")), "rows")
    groups = spark.range(35).select(F.col("id").alias("own"), (F.col("id") * 2).alias("v"))
    got = base.split_join(rows, groups, "k", "own", "by", least=100)
    assert got.columns == ["k", "by", "g", "own", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(groups, F.col("k") == F.col("own")).collect()))
