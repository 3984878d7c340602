"""Searches of whole chunks by a broadcast batch: the same as from postings, whatever the sizes of rounds and blocks."""

from __future__ import annotations

import random
import re

import pytest

from pyspark.sql import functions as F

from lorekeep.api import Memory, SearchOptions
from lorekeep.operators import batch, lexical, positional, profiles, writing

from .test_kept import corpus, covers, tokens


@pytest.fixture(params=[False, True])
def small(request, monkeypatch):
    """All limits so low that each is passed."""
    if request.param:
        for name, value in {"BROADCAST": 400, "BLOCK": 3, "CELLS": 7, "PLACES": 20, "HITS": 6}.items():
            monkeypatch.setattr(batch, name, value)


def frames(spark, seed, queries):
    chunks = [*corpus(random.Random(seed), 60), (900, None), (901, ""), (902, "w1 " * 50)]
    return spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string"), chunks


def test_search_equals_postings(spark, small):
    rng = random.Random(5)
    c, q, _ = frames(spark, 4, [(i, " ".join(f"w{rng.randrange(33)}" for _ in range(rng.randrange(0, 9)))) for i in range(12)] + [(90, None), (91, "none of these")])
    pick = lambda d: sorted((r.query_id, r.pos, r.chunk_id, r.coverage, r.strict, r.rank, r.shared, r.n) for r in d.collect())
    for k in (1, 3, 100):
        assert pick(batch.search(q, c, k)) == pick(lexical.lexical_search(q, lexical.index(c), k))
    want = {(r.query_id, r.chunk_id) for r in lexical.lexical_matches(q, lexical.index(c)).filter("strict").collect()}
    assert sorted(map(tuple, batch.strict(q, c).collect())) == sorted(want) and want


def test_search_shuffles_results_only(spark):
    """Before, each query, chunk and shared lexeme made a row of a join; no join and no aggregate is left."""
    c, q, _ = frames(spark, 4, [(1, "w1 w2")])
    plan = batch.search(q, c, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "MapInArrow" in plan


WEB = ["w1 w2", '"w1 w2"', "w1-w2", '"w1 w2 w3', "w1 -w2", 'w1 -"w2 w3"', "w1 or w2 w3", '"w1 w1" OR -w2 w3', '-"w1 w2"', "w1 or -w2", 'or "" - ', None, '"w1 w1 w1 w1"', '"w1 w2" or "w1 w2"', "zz -w1"]


def test_web_matches_equal_postings(spark, small):
    c, q, _ = frames(spark, 6, list(enumerate(WEB)))
    got = sorted(map(tuple, batch.web_matches(q, c).collect()))
    assert got == sorted(map(tuple, positional.web_matches(q, positional.positions(c)).collect())) and got


def test_cover_density_equals_brute_force(spark, small):
    rng = random.Random(1)
    queries = [(100 + i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 6)))) for i in range(12)]
    c, q, chunks = frames(spark, 1, queries)
    got = {(r.query_id, r.chunk_id): (r.covers, round(r.density, 9), r.shared, r.n) for r in batch.cover_densities(q, c).collect()}
    sets = lambda a, b: (len(set(tokens(a)) & set(tokens(b or ""))), len(set(tokens(a))))
    want = {(i, j): (n, round(d, 9), *sets(a, b)) for i, a in queries for j, b in chunks if sets(a, b)[0] for n, d in [covers(a, b)]}
    assert got == want


def test_procedures_equal_brute_force(spark, small, monkeypatch):
    """Terms count inside longer words, without overlaps; before, each task met each note that shares three letters."""
    monkeypatch.setattr(writing, "KEPT_RUNS", 5)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab_1") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() + rng.choice(["", "Ä", "."]) for _ in range(n))
    notes = [(f"Tasks/n{i}_{i % 7}.md", text(rng.randrange(0, 40))) for i in range(80)] + [("Tasks/none.md", None), ("AGENTS.md", "rules aaa")]
    tasks = [(i, text(n).upper() + " the aaaa aaa") for i, n in enumerate([0, 1, 3, 9, 20])] + [(8, None), (9, "")]
    got = writing.procedures(spark.createDataFrame(tasks, "task_id long, text string"), spark.createDataFrame(notes, "path string, text string").repartition(3), 6)
    want = []
    for i, a in tasks:
        terms = {x for x in re.findall("[a-z0-9_]{3,}", (a or "").lower()) if x != "the"}
        full = [(p, f"{t} {p[6:-3]}".lower()) for p, t in notes if t is not None and p != "AGENTS.md"]
        best = sorted((-sum(f.count(x) for x in terms), p) for p, f in full)
        want += [(i, n + 1, p) for n, p in enumerate(["AGENTS.md", *(p for s, p in best if s < 0)][:6])]
    assert sorted((r.task_id, r.pos, r.path) for r in got.collect()) == want
    assert {r.block for r in got.filter("path = 'AGENTS.md'").collect()} == {"Source: AGENTS.md\nrules aaa"}


def test_search_of_memory_makes_no_postings(spark):
    """Before, the API's search joined all pairs that share a lexeme, for the matches and once more for the rerank."""
    c = spark.createDataFrame([(i, i, i, f"w{i % 3} w1 fox", None, None, None, [], [], f"{i}.md", None, None, None, None) for i in range(9)], "chunk_id long, memory_id long, revision_id long, text string, memory_type string, project string, source_agent string, tags array<string>, entity_keys array<string>, source_file string, occurred timestamp, updated timestamp, created timestamp, importance double")
    d = c.select("memory_id", F.lit("active").alias("doc_status"), F.col("revision_id").alias("current_revision_id"))
    r = c.select("memory_id", "revision_id", F.lit("active").alias("state"))
    q = spark.createDataFrame([(1, "w2 fox bird"), (2, None)], "query_id long, text string")
    found = Memory(c, d, r).search(q, F.lit("2024-01-01").cast("timestamp"), SearchOptions(limit=3, compress=False))
    assert [(x.query_id, x.chunk_id) for x in found.orderBy("query_id", "pos").collect()] == [(1, 2), (1, 5), (1, 8)]
    assert "lexeme" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_profile_boosts_without_an_aggregate_of_pairs(spark):
    """A memory for two profiles of a query counts once; before, all pairs went through one join key a profile and an aggregate."""
    rng = random.Random(2)
    q = [(i, " ".join(f"k{rng.randrange(4)}" for _ in range(3)), [f"k{rng.randrange(6)}"]) for i in range(9)]
    f = [(f"p{rng.randrange(6)}", rng.choice(["active", "active", "superseded"]), m := rng.randrange(20), m) for _ in range(80)]
    got = profiles.profile_boosts(
        spark.createDataFrame(q, "query_id long, query_key string, entity_keys array<string>"), spark.createDataFrame([(f"p{i}", f"k{i}") for i in range(6)], "profile_id string, canonical_key string"),
        spark.createDataFrame(f, "profile_id string, status string, evidence_memory_id long, evidence_revision_id long"), spark.createDataFrame([(m, "active" if m % 5 else "gone", m) for m in range(20)], "memory_id long, doc_status string, current_revision_id long"),
    )
    want = {(i, m) for i, text, keys in q for p, s, m, _ in f if s == "active" and m % 5 and f"k{p[1]}" in [*text.split(), *keys]}
    assert sorted((r.query_id, r.memory_id) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_texts_of_candidates_stay_where_they_are(spark, monkeypatch):
    """before, all texts were shuffled to be joined with k candidates a query."""
    texts = spark.range(500).select(F.col("id").alias("chunk_id"), F.lit("x").alias("text"))
    few = spark.createDataFrame([(1, 7), (2, 7), (2, 900)], "query_id long, chunk_id long")
    found = batch.beside(few, texts, "chunk_id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and sorted(r.query_id for r in found.collect()) == [1, 2]
    monkeypatch.setattr(batch, "FEW", 2)
    more = batch.beside(few, texts, "chunk_id")
    assert "strategy=broadcast" not in more._jdf.queryExecution().optimizedPlan().toString() and sorted(map(tuple, more.collect())) == sorted(map(tuple, found.collect()))
