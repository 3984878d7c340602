"""Model plug-ins and whole-vault jobs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lorekeep.operators import models, vault_jobs


def notes(spark):
    rows = [
        ("Daily/2024-01-01.md", "old and dull", "2024-01-01", None, None),
        ("Daily/2024-02-01.md", "One. Two. Three [[Amy]].\n- lesson a\n- step b", "2024-02-01", "raw", 0.9),
        ("Daily/2024-02-10.md", "fresh [[Amy]] [[Bob]]", "2024-02-10", "raw", None),
        ("Daily/README.md", "x", None, None, None),
        ("Concepts/c.md", "y", None, None, None),
    ]
    return spark.createDataFrame(rows, "path string, body string, date string, lifecycle string, base_importance double")


def test_distil(spark):
    got = {r.path: r for r in vault_jobs.distil(notes(spark), F.lit("2024-02-05").cast("date")).collect()}
    assert set(got) == {"Daily/2024-01-01.md", "Daily/2024-02-01.md", "Daily/2024-02-10.md"}
    assert got["Daily/2024-01-01.md"].lifecycle == "archived" and got["Daily/2024-01-01.md"].new_path == "Archive/2024-01-01.md"
    p = got["Daily/2024-02-01.md"]
    assert p.actions == ["summarize", "promote"] and p.lifecycle == "distilled" and p.new_body.startswith("# Distilled Summary\nOne. ... [Distilled] ...")
    assert p.procedure_path == "Procedures/PROC_2024_02_01.md" and "Sequence of operations" in p.procedure
    assert got["Daily/2024-02-10.md"].actions == []


def test_consolidation_and_promotion(spark):
    m = vault_jobs.daily_memories(notes(spark), ("amy", "zed"))
    by = {r.id: r for r in m.collect()}
    assert by["Daily/2024-02-01.md"].lessons == ["lesson a", "step b"] and by["Daily/2024-02-10.md"].participants == ["amy"]
    many = m.unionByName(m).unionByName(m).withColumn("id", F.col("id"))
    assert {r.path for r in vault_jobs.concepts(many).collect()} >= {"Concepts/amy-amy.md"}
    refs = spark.createDataFrame([("Amy", "a"), ("Amy", "b"), ("Amy", "b"), ("Bob", "a"), ("Known", "a"), ("Known", "b")], "entity string, note string")
    got = vault_jobs.promoted_notes(refs, spark.createDataFrame([("Known",)], "entity string")).collect()
    assert [r.path for r in got] == ["Concepts/Amy.md"] and "- [[a]]\n- [[b]]" in got[0].note


def test_ids_are_stable(spark):
    d = spark.createDataFrame([("a.md", None), ("b.md", "given")], "path string, memory_id string")
    once = vault_jobs.with_ids(d)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, vault_jobs.with_ids(once).collect()))


def test_models(spark):
    n = spark.createDataFrame([("a", "A. B. C."), ("b", None)], "path string, body string")

    def down(prompts):
        raise RuntimeError("down")

    assert {r.path: r.summary for r in models.summaries(n, down).collect()}["a"] == "A. ... [Distilled] ... C."
    answer = lambda ps: [json.dumps({"lessons": ["x"]}) if "A." in p else "no json" for p in ps]
    assert {r.path: r.lessons for r in models.lessons(n, answer).collect()}["a"] == ["x"]
    w = models.written(spark.createDataFrame([(1, "# T\nbody")], "id long, text string"), lambda ps: ['```json\n{"title": "N", "body": "B"}\n```'] * len(ps))
    assert tuple(w.first()) == (1, "N", "B")
    mem = spark.createDataFrame([("t", i, i, f"m{i}" * 300) for i in range(12)], "topic string, at int, id int, text string")
    p = models.reflection_prompts(mem).first().prompt
    assert p.count("\n") == 9 and p.startswith("- m11") and max(map(len, p.split("\n"))) == 502
    assert models.reflect(mem, models.mock).count() == 1


def test_embedding_cache(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    vecs, new = models.cached_embeddings(t, None, "m", dim=4)
    assert vecs.count() == 3 and new.count() == 2
    vecs2, new2 = models.cached_embeddings(t, new, "m", dim=4)
    assert new2.count() == 0 and sorted(map(tuple, vecs.collect())) == sorted(map(tuple, vecs2.collect()))
    assert models.cached_embeddings(t, new, "other", dim=4)[1].count() == 2
