from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from lorekeep.llm.exact import exact_dedup, exact_groups

from .util import ODD, docs


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups: dict[str, list] = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def as_dict(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_groups_match_brute_force(spark):
    texts = ODD + ODD[3:] + ["same text"] * 40
    df = docs(spark, texts)
    assert as_dict(exact_groups(df)) == brute(list(enumerate(texts)))


def test_bytes_are_compared_when_hashes_collide(spark):
    texts = ["a", "b", "a", "c", "b"]
    df = docs(spark, texts)
    weak = exact_groups(df, content_hash=lambda t: F.substring(F.unhex(F.md5(t)), 1, 0))
    assert as_dict(weak) == brute(list(enumerate(texts)))


def test_repeated_rows_null_ids_and_empty(spark):
    df = docs(spark, ["t", "t", "t", "u"], ids=[5, 5, None, None])
    got = exact_groups(df).collect()
    assert sorted((r.text_sha256, r.kept) for r in got).count((hashlib.sha256(b"t").hexdigest(), True)) == 1
    assert {r.keep_id for r in got} == {5, None}
    assert exact_groups(df.limit(0)).count() == 0


def test_dedup_keeps_columns(spark):
    df = docs(spark, ["t", "t ", "t", "u"], ids=[5, 6, 5, 7]).withColumn("h", F.lit(1)).withColumn("g", F.lit(2)).withColumn("row", F.lit(3))
    got = exact_dedup(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [5, 6, 7]  # "t " keeps its trailing space
