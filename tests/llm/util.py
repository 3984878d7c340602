from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, texts: list, ids: list | None = None, langs: list | None = None, sources: list | None = None) -> DataFrame:
    n = len(texts)
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in zip(ids or range(n), texts, langs or ["en"] * n, sources or ["a"] * n, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng: random.Random, n: int, vocab: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


ODD = [None, "", " \t\n", "a", "word " * 300, "ünïcode ñ 漢字", "a b", "a  b", "a\nb", "x" * 50_000]
