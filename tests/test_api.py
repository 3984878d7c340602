"""The facade end to end on a small memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.api import Memory, SearchOptions

CHUNK = "chunk_id long, memory_id long, revision_id long, text string, memory_type string, project string, source_agent string, tags array<string>, entity_keys array<string>, source_file string, occurred string, updated string, created string, importance double"


def memory(spark):
    rows = [
        (1, 1, 11, "Docker port mapping fails on restart", "procedural", "p", "Bot", ["x"], ["docker"], "Tasks/a.md", None, None, "2024-01-31", None),
        (2, 2, 21, "Docker notes of an older revision", "semantic", "p", "bot", [], [], "Concepts/b.md", None, None, "2024-01-31", None),
        (3, 3, 31, "Gardening and tomatoes", "semantic", "q", "other", [], ["garden"], "Concepts/c.md", None, None, "2020-01-01", 2.0),
    ]
    chunks = spark.createDataFrame(rows, CHUNK).withColumn("created", F.col("created").cast("timestamp")).withColumn("occurred", F.lit(None).cast("timestamp")).withColumn("updated", F.lit(None).cast("timestamp"))
    docs = spark.createDataFrame([(1, "active", 11), (2, "active", 22), (3, "active", 31)], "memory_id long, doc_status string, current_revision_id long")
    revs = spark.createDataFrame([(1, 11, "active"), (2, 21, "superseded"), (2, 22, "active"), (3, 31, "active")], "memory_id long, revision_id long, state string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, vec array<float>")
    ents = spark.createDataFrame([("port",), ("docker",)], "entity_key string")
    claims = spark.createDataFrame([("port", "docker", "fixes", 1.0, "explicit")], "subject string, object string, predicate string, confidence double, status string")
    return Memory(chunks, docs, revs, vecs, entities=ents, claims=claims)


def test_search(spark):
    m, now = memory(spark), F.lit("2024-02-01").cast("timestamp")
    q = spark.createDataFrame([(7, "docker [[port]]", [1.0, 0.0])], "query_id long, text string, vec array<float>")
    got = m.search(q, now, SearchOptions(limit=5)).orderBy("pos").collect()
    assert [r.chunk_id for r in got] == [1, 3]  # the old revision is hidden
    assert got[0].rank_sources == ["lexical", "semantic"] and got[0].evidence_ids == ["1:11:1"] and 0.9 < got[0].score <= 1.0
    old = m.search(q, now, SearchOptions(limit=5, include_historical=True, compress=False)).collect()
    assert {r.chunk_id for r in old} == {1, 2, 3}
    only = m.search(q, now, SearchOptions(default_project="q", prefilter=True)).collect()
    assert [r.chunk_id for r in only] == [3]
    assert [r.chunk_id for r in m.search(q.drop("vec"), now).collect()] == [1]  # no dense leg: lexical answers
    assert m.search(q, now, SearchOptions(tags=("nope",))).count() == 0 and m.search(q, now, SearchOptions(limit=0)).count() == 0
    m.allowed_agents = ("BOT",)
    assert [r.chunk_id for r in m.search(q, now).collect()] == [1]
    assert m.context(q, now).first().context.startswith("Source: Tasks/a.md\n")
    assert m.summarize(q, now).count() == 1


def test_failing_legs_leave_the_others(spark):
    m, now = memory(spark), F.lit("2024-02-01").cast("timestamp")
    q = spark.createDataFrame([(7, "docker [[port]]", [1.0, 0.0])], "query_id long, text string, vec array<float>")
    down = F.raise_error(F.lit("down"))
    m.vectors = m.vectors.withColumn("vec", F.when(F.col("vec_id") > 0, down).otherwise(F.col("vec")))  # fails when it runs
    m.claims = m.claims.withColumn("confidence", F.when(F.col("confidence") > 0, down.cast("double")))
    got = m.search(q, now).collect()
    assert [r.chunk_id for r in got] == [1] and got[0].rank_sources == ["lexical"]


def test_search_from_indexes(spark, tmp_path):
    """A kept index and a vector index answer as the tables do, with filters too; the web syntax ranks by covers."""
    from lorekeep.operators import vector_index
    from lorekeep.operators.kept_index import KeptIndex
    from lorekeep.sources.commits import CommitLog

    m, now = memory(spark), F.lit("2024-02-01").cast("timestamp")
    q = spark.createDataFrame([(7, "docker [[port]]", [1.0, 0.0]), (8, "gardening", [0.1, 1.0])], "query_id long, text string, vec array<float>")
    options = [SearchOptions(include_historical=True, compress=False), SearchOptions(default_project="q", compress=False)]
    shown = lambda o: sorted((r.query_id, r.pos, r.chunk_id, tuple(r.rank_sources), round(r.score, 6)) for r in m.search(q, now, o).collect())
    want = [shown(o) for o in options]
    m.index = KeptIndex(CommitLog(spark, str(tmp_path / "log")), buckets=4)
    m.index.update(m.chunks)
    m.vector_index = vector_index.build(m.vectors, str(tmp_path / "v"), k=20, lists=2, probes=2)
    assert [shown(o) for o in options] == want
    m.vectors = None
    assert shown(options[1]) == want[1]
    web = lambda text: [r.chunk_id for r in m.search(q.filter("query_id = 7").drop("vec").withColumn("text", F.lit(text)), now, SearchOptions(syntax="web", include_historical=True, compress=False)).orderBy("pos").collect()]
    indexed = [web(t) for t in ('"port mapping" docker', "docker -port", "tomatoes or docker")]
    m.index = None
    assert indexed[1] == web("docker -port")
    assert indexed[0][0] == 1 and set(indexed[1]) == {1, 2} and set(indexed[2]) == {1, 2, 3}
