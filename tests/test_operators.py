"""Operators against hand-made cases."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import chunking, compress, dense, episodes, fusion, graph, identity, lexical, lifecycle, profiles, queues, readiness, writing
from lorekeep.sources import sinks, vault


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_lexical_orders_and_shares(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha alpha"), (3, "gamma"), (4, None)], "chunk_id long, text string")
    q = spark.createDataFrame([(9, "Alpha, BETA"), (8, ""), (7, None)], "query_id long, text string")
    got = lexical.lexical_search(q, lexical.index(chunks), 5).orderBy("pos").collect()
    assert [(r.query_id, r.chunk_id, r.coverage, r.strict, r.rank) for r in got] == [(9, 1, 1.0, True, pytest.approx(1.45)), (9, 2, 0.5, False, pytest.approx(0.75))]


def test_dense_is_exact_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(900, [0.0] * 8), (901, [1.0] * 3)]
    v = spark.createDataFrame(vecs, "vec_id long, vec array<float>").repartition(3)
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")

    def cos(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    by = dict((r.vec_id, list(r.vec)) for r in v.collect())
    want = {i: [x for _, x in sorted((-round(cos(by[i], w), 9), j) for j, w in by.items() if len(w) == 8)][:5] for i in (0, 50, 100, 150)}
    for block in (4096, 2):
        monkeypatch.setattr(dense, "BLOCK", block)
        got = {}
        for r in dense.dense_search(q, v, 5).orderBy("query_id", "pos").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert {k: got[k] for k in want} == want
    near = dense.lsh_search(q.filter("query_id < 200"), v.filter("size(vec) = 8"), 8, 5, tables=40, bits=4)
    hit = sum(r.vec_id in want[r.query_id] for r in near.collect())
    assert hit >= 0.9 * 20


def test_fusion_and_visibility(spark):
    lists = spark.createDataFrame([(1, "lexical", 10, 1, 1.2), (1, "semantic", 10, 2, 0.8), (1, "semantic", 11, 1, 0.9)], "query_id long, source string, chunk_id long, pos int, score double")
    f = fusion.fuse(lists)
    got = {r.chunk_id: r for r in f.collect()}
    assert got[10].rrf == pytest.approx(1 / 61 + 1 / 62) and got[10].rank_sources == ["lexical", "semantic"] and got[11].lexical is None
    keyed = f.withColumn("memory_id", F.col("chunk_id")).withColumn("revision_id", F.when(F.col("chunk_id") == 10, 1))
    visible = spark.createDataFrame([(10, 1), (11, 1)], "memory_id long, revision_id int")
    assert [r.chunk_id for r in fusion.visible_only(keyed, visible).collect()] == [10]


def test_compress(spark):
    long_text = " ".join(f"Sentence number {i} has words." for i in range(60))
    data = [(1, 1, "alpha beta gamma " * 10, ["a"]), (1, 2, "alpha beta gamma " * 10 + "x", ["b"]), (1, 3, long_text, ["c"]), (1, 4, "tail", ["d"]), (2, 1, None, None)]
    df = spark.createDataFrame(data, "query_id long, pos int, text string, evidence_ids array<string>")
    got = {(r.query_id, r.pos): r for r in compress.compress(df, budget=100).collect()}
    assert got[(1, 1)].evidence_ids == ["a", "b"]
    assert "[Content Compressed]" in got[(1, 2)].text and got[(1, 3)].text == "tail" and got[(2, 1)].text == ""
    assert compress.context(compress.compress(df, 100).withColumn("source_file", F.lit("s"))).count() == 2


def test_lifecycle(spark):
    e = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2), (2, "c", 1, 3)], "memory_id long, revision_id string, activated_at int, seq int")
    r = {x.revision_id: x for x in lifecycle.revisions(e).collect()}
    assert (r["a"].state, r["a"].superseded_at, r["b"].previous_id, r["b"].state, r["c"].version) == ("superseded", 2, "a", "active", 1)
    again = lifecycle.revisions(e.orderBy(F.rand()).union(e.limit(0)))
    assert rows(again) == rows(lifecycle.revisions(e))
    new = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, "x")], "memory_id long, content_hash string")
    assert rows(lifecycle.new_revisions(new, new.filter("content_hash = 'y'"))) == [(1, "x"), (None, "x")]
    docs = spark.createDataFrame([(1, "active"), (2, "active"), (3, "deleted")], "memory_id long, doc_status string")
    assert [x.memory_id for x in lifecycle.missing(docs, docs.filter("memory_id = 1")).collect()] == [2]
    assert lifecycle.missing(docs, docs.limit(0), spark.createDataFrame([(None,)], "memory_id long")).count() == 0
    v = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, vec array<float>")
    assert lifecycle.embedded(v, 2).count() == 1
    with pytest.raises(Exception, match="dimensions"):
        lifecycle.embedded(v, 3).collect()


def test_as_of(spark):
    f = lifecycle.facts(spark.createDataFrame([(1, "k", "old", 1, 1), (1, "k", "new", 5, 2)], "profile_id long, fact_key string, fact_value string, at int, seq int"))
    assert [r.fact_value for r in lifecycle.as_of(f, F.lit(4)).collect()] == ["old"]
    assert [r.fact_value for r in lifecycle.as_of(f, F.lit(5)).collect()] == ["new"]
    assert lifecycle.as_of(f, F.lit(0)).count() == 0


def test_queue(spark):
    b = spark.sql("SELECT 1 AS outbox_id, 'pending' AS status, 0 AS attempts, TIMESTAMP '2024-01-01' AS available_at, NULL::timestamp AS locked_at UNION ALL SELECT 2, 'processing', 7, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01' UNION ALL SELECT 3, 'processing', 1, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02'")
    now = F.lit("2024-01-02").cast("timestamp")
    c = queues.claim(b, now)
    assert [(r.outbox_id, r.attempts) for r in c.orderBy("outbox_id").collect()] == [(1, 1), (2, 8)]
    f = {r.outbox_id: r for r in queues.failed(c, now).collect()}
    assert f[1].status == "pending" and str(f[1].available_at) == "2024-01-02 00:00:02" and f[2].status == "failed"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "uses"), ("b", "c", "fixes"), ("c", "d", "x"), ("z", "y", "x")], "src string, dst string, relation string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reached(seed, e, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.reached(seed, e, 99).select("node")) == [("a",), ("b",), ("c",), ("d",)]
    assert rows(graph.ego(F.lit("B"), e, 2).select("node")) == [("b",), ("c",), ("d",)]
    assert rows(graph.induced(graph.reached(seed, e, 1), e).select("src", "dst")) == [("a", "b")]
    p = spark.createDataFrame([("n", "X uses [[B]]. [[A]] depends on [[B]]!\nSee also [[C|see]]")], "source_file string, text string")
    assert rows(graph.prose(p)) == [("A", "B", "depends_on"), ("DOC:n", "A", "references"), ("DOC:n", "B", "references"), ("DOC:n", "C", "references")]
    claims = spark.createDataFrame([("a", "b", "fixes", 1.0), ("a", "c", "other", 1.0)], "subject string, object string, predicate string, confidence double")
    seeds = spark.createDataFrame([(1, "a")], "query_id long, entity_key string")
    assert rows(graph.expand(seeds, claims)) == [(1, "b", 0.1), (1, "c", 0.03)]
    assert rows(graph.expand(seeds, claims, 1)) == [(1, "b", 0.1)]


def test_profiles(spark):
    q = spark.createDataFrame([(1, "what does ada lovelace like", []), (2, "nothing", ["grace"])], "query_id long, query_key string, entity_keys array<string>")
    p = spark.createDataFrame([(1, "ada lovelace"), (2, "grace"), (3, "bob%")], "profile_id long, canonical_key string")
    f = spark.createDataFrame([(1, "active", 10, 100), (2, "active", 20, 200), (1, "superseded", 30, 300)], "profile_id long, status string, evidence_memory_id long, evidence_revision_id long")
    d = spark.createDataFrame([(10, "active", 100), (20, "active", 999), (30, "active", 300)], "memory_id long, doc_status string, current_revision_id long")
    assert rows(profiles.profile_boosts(q, p, f, d)) == [(1, 10, 0.08)]


def test_notes_and_chunks(spark, tmp_path):
    note = "---\nmemory_id: abc\ntype: tasks\ntags: [x]\nrelated_to: '[[Other]]'\nrelationships:\n  - relation: depends on\n    target: '[[B]]'\n---\n# Title\nintro #tag [[Link|l]]\n## One\n```\n# not a heading\n```\n# Second\n\n## Empty\n### Deep\ntext\n"
    (tmp_path / "Tasks").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "Tasks" / "n.md").write_text(note)
    (tmp_path / ".git" / "x.md").write_text("no")
    (tmp_path / "bad.md").write_text("---\n- list\n---\n")
    got = vault.scan(spark, str(tmp_path))
    assert sorted(r.path for r in got.collect()) == ["Tasks/n.md", "bad.md"]
    p = {r.path: r for r in chunking.parsed(got).collect()}
    n = p["Tasks/n.md"]
    assert (n.memory_id, n.memory_type, n.title, n.tags, n.related_to, n.error) == ("abc", "procedural", "Title", ["x"], ["Other"], None)
    assert [tuple(r) for r in n.relationships] == [("depends_on", "B", "explicit")] and p["bad.md"].error
    c = chunking.chunks(chunking.parsed(got).filter("error is null")).orderBy("ordinal").collect()
    assert [(r.heading_path, r.content.split("\n\n", 1)[1]) for r in c] == [(["Title"], "intro #tag [[Link|l]]"), (["Title", "One"], "```\n# not a heading\n```"), (["Title", "Second", "Empty", "Deep"], "text")]
    assert c[0].entities == ["Link"] and c[0].tags == ["tag"]
    proj = graph.project(chunking.parsed(got).filter("error is null").withColumn("seq", F.lit(1)))
    assert rows(proj["claims"].select("subject", "predicate", "object", "confidence")) == [("title", "depends_on", "b", 1.0), ("title", "related_to", "other", 1.0)]
    assert rows(proj["entities"].select("entity_key")) == [("link",), ("title",)]


def test_long_sections_overlap():
    parts = chunking.split_long("\n\n".join(c * 600 for c in "abcd"), 1500)
    assert parts == ["a" * 600 + "\n\n" + "b" * 600, "b" * 600 + "\n\n" + "c" * 600, "c" * 600 + "\n\n" + "d" * 600]
    assert chunking.split_long("x") == ["x"] and chunking.sections(pd.DataFrame({"path": ["s"], "body": [""]})).empty


def test_write_path(spark):
    old = spark.createDataFrame([("b.md", "# Alpha\nold words"), ("a.md", "# alpha\nother")], "path string, text string")
    new = spark.createDataFrame([(1, "semantic", "# Alpha\nother", None), (2, "semantic", "# Alpha\nnews", None), (3, "daily", "# Alpha\nnews", None), (4, "semantic", "# Beta", None), (5, "daily", "# Alpha", True)], "id long, category string, text string, dedup boolean")
    got = {r.id: (r.decision, r.match_path) for r in writing.write_decisions(new, old).collect()}
    assert got[2] == ("UPDATE", "a.md") and got[3] == ("ADD", None) and got[4] == ("ADD", None) and got[5][0] in ("NOOP", "UPDATE")
    r = spark.range(1).select(writing.edit(F.lit("a b a"), F.lit("a"), F.lit("c")), writing.edit(F.lit("x"), F.lit("a"), F.lit("c")), writing.edit(F.lit("a"), F.lit("a"), F.lit("c"), F.lit("bad")), writing.add_link(F.lit("t [[X]]"), F.lit("X")), writing.add_link(F.lit("t"), F.lit("X")), writing.archived_path(F.lit("a.md")), writing.updated_body(F.lit("# A\nold"), F.lit("# A\nnew"), F.lit("A"), F.lit("2024-01-02").cast("date"))).first()
    assert tuple(r[0]) == ("c b a", "edited") and tuple(r[1]) == ("x", "not_found") and tuple(r[2]) == ("a", "conflict")
    assert list(r[3:]) == ["t [[X]]", "t\n\n[[X]]\n", "Archive/a.md", "# A\nold\n\n## Update (2024-01-02)\nnew"]
    tasks = spark.createDataFrame([(1, "deploy the docker image")], "task_id long, text string")
    notes = spark.createDataFrame([("AGENTS.md", "rules"), ("Tasks/a.md", "docker docker"), ("Tasks/b.md", "dockerfile deploy image now"), ("Tasks/c.md", "nothing")], "path string, text string")
    assert [r.path for r in writing.procedures(tasks, notes).orderBy("pos").collect()] == ["AGENTS.md", "Tasks/b.md", "Tasks/a.md"]


def test_evaluation(spark):
    res = spark.createDataFrame([(1, 1, "a", 1, 1), (2, 3, "b", 2, 1)], "query_id long, pos int, source_file string, memory_id long, revision_id long")
    exp = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, source_file string")
    cases = {r.query_id: (r.hit1, r.hit5, round(r.reciprocal_rank, 3), r.leaks) for r in readiness.evaluate(res, exp, res.filter("memory_id = 1")).collect()}
    assert cases == {1: (True, True, 1.0, 0), 2: (False, True, 0.333, 1), 3: (False, False, 0.0, 0)}
    assert readiness.gate(readiness.summary(readiness.evaluate(res, exp))).first().passed is False


def test_episodes(spark):
    r = spark.range(1).select(episodes.importance_b(F.lit("I love this great goal"), None, F.lit(5)), episodes.threshold(F.lit(None).cast("string")), episodes.quality(F.lit("---\ntype: x\ndate: d\ntags: t\n---\n# H\n- [[A]] [[B]]\n" + "w " * 60)), episodes.dominant({"a": F.lit(1.0), "b": F.lit(1.0)})).first()
    assert r[0] == pytest.approx(round((0.9 + 0.6) / 18 * 0.3 + min(1, 3 / 4 * 1.5) * 0.2 + min(1, 1 / 14 * 2) * 0.3 + 0.2, 4)) and r[1] == 0.25
    assert r[2].score == pytest.approx(0.56) and r[2].grade == "C" and r[3] == "a"


def test_identity_fold_and_summary(spark):
    got = spark.range(1).select(identity.fold(F.lit(0.5), F.array(F.lit(1.0), F.lit(0.0)))).first()[0]
    assert got == pytest.approx(round(round(0.5 * 0.7 + 0.3, 4) * 0.7 + 0.5 * 0.3, 4))
    v = spark.createDataFrame([(1, 1, "a", 0.5), (1, 2, "a", 0.7), (1, 1, "b", 0.5), (1, 2, "c", 0.1)], "entity_id long, version_number int, trait_id string, confidence double")
    assert rows(identity.change_summary(identity.drift(v))) == [(1, "a:up:0.20; removed:b; new:c")]
    assert identity.rollback(v, 1).count() == 2


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("c", 1, [1.0]), ("c", 2, None)], "collection string, vec_id long, vec array<float>")
    path = sinks.write_vectors(v, str(tmp_path), "1", 1)
    alias = str(tmp_path / "current.json")
    sinks.switch(spark, alias, path)
    assert rows(sinks.served(spark, alias).select("vec_id", "vec")) == [(1, [1.0]), (2, [0.0])]
    sinks.switch(spark, alias, sinks.write_vectors(v.limit(1), str(tmp_path), "2", 1))
    assert sinks.served(spark.newSession(), alias).count() == 1  # any reader of the file sees the new version
    with pytest.raises(Exception, match="(?i)path|schema"):
        sinks.switch(spark, alias, str(tmp_path / "nothing"))
    assert sinks.served(spark, alias).count() == 1
    e = spark.createDataFrame([("a'b", "c", "depends on")], "src string, dst string, relation string")
    got = sinks.merge_statements(e.selectExpr("src AS node"), e).orderBy("seq").collect()
    assert [r.statement for r in got] == ["MERGE (:Entity {name: 'a\\'b'})", "MATCH (a:Entity {name: 'a\\'b'}), (b:Entity {name: 'c'}) MERGE (a)-[:DEPENDS_ON]->(b)"]
    sinks.graph_html(e, str(tmp_path / "g.html"))
    assert '[["a\'b", "depends on", "c"]]' in (tmp_path / "g.html").read_text()
    with pytest.raises(ValueError):
        sinks.graph_html(e.union(e), str(tmp_path / "g.html"), 1)
    sinks.append(v.drop("vec"), str(tmp_path / "log"))
    sinks.append(v.drop("vec"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_initial_confidence_does_not_depend_on_partitions(spark):
    """Means that lie on a fifth decimal's tie came out by the order in which partial sums met."""
    rng = random.Random(3)
    values = [(e, i, rng.randrange(1, 6000) / 100 / 60) for e in range(1500) for i in range(12)]
    found = spark.createDataFrame([(e, i, "t", "d", s, i) for e, i, s in values], "entity_id long, memory_id long, trait_id string, domain_id string, strength double, detected_at long")
    rows = lambda n: {r.entity_id: r.initial for r in identity.traits(found.withColumn("detected_at", F.timestamp_seconds("detected_at")).repartition(n, "memory_id")).select("entity_id", "initial").collect()}
    assert rows(1) == rows(3) == rows(7)
