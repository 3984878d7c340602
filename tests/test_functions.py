"""Functions that SQL cannot express, against Python and hand-computed values."""

from __future__ import annotations

import hashlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import ids as I
from lorekeep.functions import scores as S
from lorekeep.functions import text as T
from lorekeep.functions import udfs, vectors


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_identifiers_match_python(spark):
    for name in ("Concepts/a.md", "é/ü.md", ""):
        r = one(spark, I.memory_id(F.lit(None).cast("string"), F.lit(name)), I.content_hash(F.lit(name)), I.point_id(F.lit(name)), I.memory_id(F.lit("given"), F.lit(name)))
        assert r[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
        assert r[1] == hashlib.sha256(b"projection-v2\x00" + name.encode()).hexdigest()
        assert r[2] == str(uuid.UUID(hashlib.md5(name.encode()).hexdigest()))
        assert r[3] == "given"


def test_entity_keys():
    assert udfs.entity_key("  Ａlpha　 Beta ") == "alpha beta"
    assert udfs.entity_key(None) is None


@pytest.mark.parametrize(
    ("raw", "meta", "body"),
    [
        ("---\ntype: concept\ntags: [a, 'b c']\n---\nbody\n", {"type": "concept", "tags": ["a", "b c"]}, "body\n"),
        ("﻿---\r\na: 1\r\n---\r\nx", {"a": 1}, "x"),
        ("---\nlist:\n  - x\n  - predicate: uses\n    target: '[[Y]]'\nmap:\n  k: 1.5\n---\n", {"list": ["x", {"predicate": "uses", "target": "[[Y]]"}], "map": {"k": 1.5}}, ""),
        ("---\nlink: [[X]]\nempty:\n---\n", {"link": [["X"]], "empty": None}, ""),
        ("no front matter", {}, "no front matter"),
        ("", {}, ""),
        (None, {}, ""),
        ("---\n---\nz", {}, "z"),
    ],
)
def test_front_matter(raw, meta, body):
    assert udfs.front_matter(raw) == (meta, body)


@pytest.mark.parametrize("raw", ["---\n- a\n- b\n---\n", "---\njust text\n---\n", "---\na: 1\n   b: 2\n---\n", "---\na: {x\n---\n"])
def test_malformed_front_matter(raw):
    with pytest.raises(ValueError):
        udfs.front_matter(raw)


def test_embeddings(spark):
    v = udfs.fake_embedding("x", 64)
    assert len(v) == 64 and v == udfs.fake_embedding("x", 64) and all(-1 <= x <= 1 for x in v)
    r = one(spark, udfs.embed_udf(dim=16, most=4)(F.lit("abcdefgh")))[0]
    a, b = udfs.fake_embedding("abcd", 16), udfs.fake_embedding("efgh", 16)
    s = [x + y for x, y in zip(a, b)]
    n = math.sqrt(sum(x * x for x in s))
    assert all(abs(x - y / n) < 1e-6 for x, y in zip(r, s))


def test_stems():
    assert [udfs.porter_stem(w) for w in ("caresses", "ponies", "cats", "agreed", "plastered", "motoring", "hopping", "happy", "sky")] == ["caress", "poni", "cat", "agree", "plaster", "motor", "hop", "happi", "sky"]


def test_scores(spark):
    t = F.lit("2024-02-15").cast("timestamp")
    r = one(spark, S.recency_boost(t, F.lit("2024-02-01").cast("timestamp")), S.recency_boost(t, F.lit("2025-01-01").cast("timestamp")), S.recency_boost(t, F.lit(None).cast("timestamp")), S.sigmoid(F.lit(-1000.0)), S.sigmoid(F.lit(1000.0)), S.importance_boost(F.lit(1.0)), S.importance_boost(F.lit(0.0)), S.heuristic_rerank(F.lit(2), F.lit(4), F.lit(400)), S.rerank_blend(F.lit(1.0), F.lit(5.0)))
    assert list(r) == [0.075, 0.15, 0.0, 0.0, 1.0, 0.0, -0.05, pytest.approx(0.5), 1.0]


def test_base_score_cases(spark):
    f = lambda rrf, top, sem, lex, n: one(spark, S.base_score(F.lit(rrf), F.lit(top), F.lit(sem).cast("double"), F.lit(lex).cast("double"), F.lit(n)))[0]
    assert f(0.02, 0.02, None, 0.1, 1) == pytest.approx(0.4 + 0.4 * 0.5 + 0.1)  # a lexical hit counts half at least
    assert f(0.01, 0.02, 0.9, None, 1) == pytest.approx(0.2 + 0.36 + 0.1)
    assert f(0.02, 0.02, 3.0, 1.4, 2) == pytest.approx(1.0)


def test_text_functions(spark):
    rows = spark.createDataFrame([("A b. C d! E? F. G h.",), ("one",), ("",)], "t string")
    got = [tuple(r) for r in rows.select(T.sentences(F.col("t")), T.heuristic_summary(F.col("t")), T.token_estimate(F.col("t")), T.title(F.col("t")), T.slug(F.col("t"))).collect()]
    assert got[0] == (["A b.", "C d!", "E?", "F.", "G h."], "A b. ... [Distilled] ... G h.", 10, "A b. C d! E? F. G h.", "a-b-c-d-e-f-g-h")
    assert got[1][1:] == ("one", 1, "one", "one")
    assert got[2] == ([], "", 0, "Memory", "memory")
    r = one(spark, T.query_entities(F.lit("What about [[X]] and Foo")), T.query_entities(F.lit("How does EditFailure A work")), T.clean_link(F.lit(" [[ A b|c#d]] ")), T.predicate(F.lit("Depends-On it")), T.string_list(F.array(F.lit(" a"), F.lit(""), F.lit("a"), F.lit(None))))
    assert list(r) == [["X"], ["EditFailure"], "A b", "depends_on_it", ["a"]]
    rels = spark.createDataFrame([([{"relation": "Depends on", "entity": "[[B]]"}, {"type": "uses"}, {"predicate": "x", "target": "C", "status": "candidate"}],)], "r array<map<string,string>>")
    assert [tuple(x) for x in rels.select(T.relationships(F.col("r"))).first()[0]] == [("depends_on", "B", "explicit"), ("x", "C", "candidate")]


def test_vectors(spark):
    r = one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), vectors.weighted_mean(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))), F.array(F.lit(3.0), F.lit(4.0)), 2), vectors.routed(F.lit(None).cast("array<float>"), 2))
    assert r[0] == pytest.approx(math.sqrt(0.5)) and r[1] == 0.0 and r[2] == pytest.approx([0.6, 0.8]) and r[3] == [0.0, 0.0]
