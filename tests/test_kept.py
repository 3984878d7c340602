"""Positional postings, web queries, the kept index, commits, the vector index and the reranker against plain versions."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import batch, dense, kept_index, lexical, positional, rerank, staging, vector_index
from lorekeep.operators.kept_index import KeptIndex
from lorekeep.sources.commits import CommitLog, Conflict



def tokens(text):
    return re.findall("[a-z0-9]+", text.lower())


def corpus(rng, n, vocab=30, most=40):
    return [(i, " ".join(f"w{min(rng.randrange(vocab), rng.randrange(vocab))}" for _ in range(rng.randrange(0, most)))) for i in range(n)]


def covers(query, text):
    """Density by all runs: the shortest that hold all shared lexemes and hold no other such run."""
    own, ws = set(tokens(query)) & set(tokens(text)), tokens(text)
    runs = [(p, q) for p in range(len(ws)) for q in range(p, len(ws)) if own <= set(ws[p : q + 1])]
    least = [r for r in runs if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in runs)]
    return len(least), sum(0.1 / (1 + sum(w not in own for w in ws[p : q + 1])) for p, q in least)


def test_cover_density_equals_brute_force(spark):
    rng = random.Random(1)
    chunks, queries = corpus(rng, 60), [(100 + i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 6)))) for i in range(12)]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    got = {(r.query_id, r.chunk_id): (r.covers, round(r.density, 9)) for r in positional.cover_densities(q, positional.positions(c)).collect()}
    want = {(i, j): (n, round(d, 9)) for i, a in queries for j, b in chunks if set(tokens(a)) & set(tokens(b)) for n, d in [covers(a, b)]}
    assert got == want and positional.cover_densities(q, positional.positions(c, queries=q)).count() == len(want)


def test_close_words_outrank_distant_ones(spark):
    """Several lexemes count the more the closer they stand, which a count of places does not tell."""
    c = spark.createDataFrame([(1, "red fox and"), (2, "red and the and fox")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "red fox")], "query_id long, text string")
    near = {r.chunk_id: round(r.density, 9) for r in positional.cover_densities(q, positional.positions(c)).collect()}
    assert near == {1: 0.1, 2: 0.025}
    old = {r.chunk_id: r.rank for r in lexical.lexical_matches(q, lexical.index(c)).collect()}
    new = {r.chunk_id: r.rank for r in positional.web_search_matches(q, positional.positions(c)).collect()}
    assert old[1] == old[2] and new[1] > new[2]


def holds(text, run):
    return f" {' '.join(run)} " in f" {' '.join(tokens(text))} "


@pytest.mark.parametrize(
    "query, rule",
    [
        ("w1 w2", lambda t: holds(t, ["w1"]) and holds(t, ["w2"])),
        ('"w1 w2"', lambda t: holds(t, ["w1", "w2"])),
        ("w1-w2", lambda t: holds(t, ["w1", "w2"])),
        ('"w1 w2 w3', lambda t: holds(t, ["w1", "w2", "w3"])),
        ("w1 -w2", lambda t: holds(t, ["w1"]) and not holds(t, ["w2"])),
        ('w1 -"w2 w3"', lambda t: holds(t, ["w1"]) and not holds(t, ["w2", "w3"])),
        ("w1 or w2 w3", lambda t: holds(t, ["w1"]) or (holds(t, ["w2"]) and holds(t, ["w3"]))),
        ('"w1 w1" OR -w2 w3', lambda t: holds(t, ["w1", "w1"]) or (holds(t, ["w3"]) and not holds(t, ["w2"]))),
        ('-"w1 w2"', lambda t: (holds(t, ["w1"]) or holds(t, ["w2"])) and not holds(t, ["w1", "w2"])),
        ("w1 or -w2", lambda t: holds(t, ["w1"])),
        ('or "" - ', lambda t: False),
        (None, lambda t: False),
    ],
)
def test_web_queries(spark, query, rule):
    chunks = corpus(random.Random(2), 150, vocab=6, most=12)
    c = spark.createDataFrame(chunks, "chunk_id long, text string")
    q = spark.createDataFrame([(1, query)], "query_id long, text string")
    got = sorted(r.chunk_id for r in positional.web_matches(q, positional.positions(c)).collect())
    assert got == [i for i, t in chunks if rule(t)]


def test_kept_index_follows_updates_and_search_is_exact(spark, tmp_path):
    rng = random.Random(3)
    index = KeptIndex(CommitLog(spark, str(tmp_path / "log")), buckets=4, parts=3)
    now: dict[int, str] = {}
    frame = lambda d: spark.createDataFrame(list(d.items()), "chunk_id long, text string")
    assert index.postings().count() == 0
    for step in range(4):
        new = dict(corpus(rng, 40, vocab=60, most=30)) if step == 0 else {i: t for i, t in corpus(rng, 60, vocab=60, most=30) if rng.random() < 0.5}
        gone = [i for i in now if i in new or rng.random() < 0.1]
        index.update(frame(new), spark.createDataFrame([(i,) for i in gone] or [(-1,)], "chunk_id long"))
        now = {**{i: t for i, t in now.items() if i not in gone}, **new}
        if step == 2:
            index.merge()
        got = {(r.chunk_id, r.lexeme): list(r.places) for r in index.postings().collect()}
        assert got == {(r.chunk_id, r.lexeme): list(r.places) for r in positional.positions(frame(now)).collect()}
    q = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(70)}" for _ in range(n))) for i, n in enumerate([1, 2, 3, 8, 15, 25])] + [(9, "none of these"), (10, None)], "query_id long, text string")
    pick = lambda d: sorted((r.query_id, r.pos, r.chunk_id, r.strict, round(r.rank, 9)) for r in d.collect())
    for k in (1, 3, 100):
        want = pick(lexical.lexical_search(q, lexical.index(frame(now)), k))
        assert pick(index.search(q, k)) == want and pick(index.search(q, k, rounds=False)) == want


def test_search_reads_only_the_index(spark, tmp_path):
    """No chunk is scanned, and of the postings only the buckets of the query's lexemes."""
    folder = str(tmp_path / "chunks")
    spark.createDataFrame(corpus(random.Random(4), 50, vocab=200), "chunk_id long, text string").write.parquet(folder)
    index = KeptIndex(CommitLog(spark, str(tmp_path / "log")), buckets=32)
    index.update(spark.read.parquet(folder))
    q = spark.createDataFrame([(1, "w1 w2")], "query_id long, text string")
    plan = index.search(q, 5)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert folder not in plan and "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:60]


def table(spark, n, start=0):
    return spark.range(start, start + n).withColumnRenamed("id", "x")


def test_commits_are_seen_whole_or_not_at_all(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.version() == 0 and log.read("a") is None
    tx = log.begin()
    tx.append("a", table(spark, 3))
    tx.append("b", table(spark, 2))
    assert tx.commit() == 1
    dead = log.begin()  # a writer that dies between its tables
    dead.append("a", table(spark, 100))
    count = lambda t, v=None: log.read(t, v).count()
    assert (count("a"), count("b")) == (3, 2)
    tx = log.begin()
    tx.append("a", table(spark, 1, 10))
    tx.replace("b", table(spark, 7))
    assert tx.commit() == 2 and (count("a"), count("b"), count("a", 1), count("b", 1)) == (4, 7, 3, 2)
    one, two = log.begin(), log.begin()
    one.append("a", table(spark, 1))
    two.append("a", table(spark, 1))
    assert (one.commit(), two.commit(), count("a")) == (3, 4, 6)  # appends do not conflict
    one, two = log.begin(), log.begin()
    assert two.read("a").count() == 6
    one.append("a", table(spark, 1))
    two.replace("b", table(spark, 1))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert count("b") == 7
    tx = log.begin()
    tx.replace("b", table(spark, 0))
    tx.commit()
    assert count("b") == 0


def test_staging(spark, tmp_path):
    log, at = CommitLog(spark, str(tmp_path / "log")), F.lit("2024-01-01").cast("timestamp")
    shape = "memory_id long, revision_id long, path string, doc_status string, mtime_ns long, file_size long, content_hash string"
    batch = lambda *rows: spark.createDataFrame(rows, shape)
    chunks = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (1, 11, "c")], "memory_id long, revision_id long, text string")
    state = lambda: {(r.memory_id, r.revision_id): r.state for r in staging.revisions(log).collect()}
    heads = lambda: {r.memory_id: (r.path, r.doc_status, r.mtime_ns, r.current_revision_id) for r in staging.documents(log).collect()}
    staging.stage(log, batch((1, 10, "p", "active", 5, 6, "h1"), (2, 20, "q", "active", None, None, "h2")), at, {"chunks": chunks})
    assert state() == {(1, 10): "staged", (2, 20): "staged"} and heads()[1] == ("p", "active", 5, None)
    assert log.read("chunks").count() == 2 and log.read("outbox").count() == 2
    staging.activate(log, spark.createDataFrame([(1, 10)], "memory_id long, revision_id long"), at)
    assert state() == {(1, 10): "active", (2, 20): "staged"} and heads()[1][3] == 10
    staging.stage(log, batch((1, 12, "p2", "active", None, 7, "h1"), (2, 21, "q", "active", None, None, "h3")), at)  # known and current; new
    assert state() == {(1, 10): "active", (2, 20): "staged", (2, 21): "staged"} and heads()[1] == ("p2", "active", 5, 10)
    staging.activate(log, spark.createDataFrame([(2, 20), (2, 21)], "memory_id long, revision_id long"), at)
    assert state()[2, 20] == "superseded" and state()[2, 21] == "active" and heads()[2][3] == 21
    staging.stage(log, batch((2, 22, "q", "deleted", None, None, "h2")), at)  # old content again
    assert state()[2, 20] == "staged" and state()[2, 21] == "active" and heads()[2][:2] == ("q", "deleted")
    staging.stage(log, batch((2, 23, "q", "active", None, None, "h3")), at)  # current content, but the document was deleted
    assert state()[2, 21] == "staged"
    kinds = [r.event_type for r in log.read("audit").collect()]
    assert sorted(set(kinds)) == ["revision_activated", "revision_restaged", "revision_staged"] and kinds.count("revision_restaged") == 2
    with pytest.raises(ValueError):
        staging.stage(log, batch(), at, {"other": chunks})


def test_dense_search_leaves_vectors_where_they_are(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 8)))] + [(900, [1.0, 2.0]), (901, None)], "vec_id long, vec array<double>").repartition(6)
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    found = dense.dense_search(q, v, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan and "q_dim" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    once = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(dense, "BROADCAST", 500)  # several rounds
    assert sorted(map(tuple, dense.dense_search(q, v, 4).collect())) == once
    rows = {r.vec_id: np.array(r.vec) for r in v.filter("vec IS NOT NULL").collect()}
    cos = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for i in (0, 290, 900):
        best = sorted(((-cos(rows[i], x), j) for j, x in rows.items() if len(x) == len(rows[i])))[:4]
        assert [(j, -s) for s, j in best] == [(x[1], x[2]) for x in sorted(once, key=lambda x: x[3]) if x[0] == i]


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(6)
    home = rng.normal(size=(30, 16))
    x = home[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, [1.0]), (9001, None)], "vec_id long, vec array<float>")
    made = vector_index.build(v, str(tmp_path / "v"), k=10)
    assert made.recall >= vector_index.RECALL and made.probes < len(made.centroids) / 2
    index = vector_index.opened(spark, str(tmp_path / "v"))
    assert (index.probes, index.kind) == (made.probes, "array<float>") and np.allclose(index.centroids, made.centroids)
    assert index.rows(spark).count() == 3000
    q = v.filter("vec_id % 50 = 0 AND vec_id < 9000").select(F.col("vec_id").alias("query_id"), "vec")
    pairs = lambda d: {(r.query_id, r.vec_id): r.score for r in d.collect()}
    exact, got = pairs(dense.dense_search(q, v, 10)), pairs(vector_index.search(q, index))
    assert len(set(exact) & set(got)) >= 0.9 * len(exact) and all(got[k] == exact[k] for k in set(exact) & set(got))
    assert pairs(vector_index.search(q, index, probes=len(index.centroids))) == exact
    one = vector_index.search(q.limit(1), index)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in one.replace("isnotnull(list", "[list") or "list#" in one.split("PartitionFilters")[1][:80]
    empty = vector_index.build(v.limit(0), str(tmp_path / "e"))
    assert vector_index.search(q, empty).count() == 0


def test_reranker(spark):
    df = spark.createDataFrame([(1, "a b", "b c", 0.5), (2, "a b", None, 0.5), (3, None, "x", 0.5), (4, "bad", "x", 0.5)], "id long, q string, t string, score double")

    def load():
        def model(pairs):
            if any(q == "bad" for q, _ in pairs):
                raise ValueError
            return [float(len(q) + len(t)) for q, t in pairs]

        return model

    def broken():
        raise OSError

    out = lambda load, n: {r.id: r.x for r in df.select("id", rerank.model_logits(load, n)("q", "t").alias("x")).collect()}
    assert out(load, 1) == {1: 6.0, 2: 3.0, 3: 1.0, 4: None} and set(out(broken, 2).values()) == {None}
    both = df.select("id", rerank.blended(F.col("score"), rerank.model_logits(load, 1)("q", "t"), F.lit(1.0)).alias("x")).collect()
    assert {r.id: round(r.x, 6) for r in both}[4] == 0.6 and round(both[2].x, 6) == round(0.6 / (1 + np.exp(-1)) + 0.2, 6)


def test_blocks_of_postings(monkeypatch):
    """chunks are posted where they are, block by block; a block's lists lose what is gone, and its best are found in arrays."""
    monkeypatch.setattr(kept_index, "TOKENS", 25)
    monkeypatch.setattr(kept_index, "HITS", 7)
    rng = random.Random(8)
    chunks = [(i + 5, tokens(t)) for i, (_, t) in enumerate([*corpus(rng, 30, vocab=12), (0, ""), (0, "w1 " * 60)])]
    b = pa.RecordBatch.from_arrays([pa.array([i for i, _ in chunks]), pa.array([ws for _, ws in chunks], pa.list_(pa.string()))], names=["chunk_id", "tokens"])
    rows = pa.Table.from_batches(list(kept_index._posted(iter([b]))))
    live = {i: ws for i, ws in chunks if i % 3}
    queries = pa.table({"query_id": [1, 2, 3], "own": [["w1", "w2", "zz"], ["w3"], ["w1", "w4", "w5", "w6"]]})
    found, got, members = [], {}, []
    for block in sorted(set(rows["block"].to_pylist())):
        own = rows.filter(pc.equal(rows["block"], block))
        members += own.filter(pc.is_null(own["lexeme"]))["chunk_ids"].to_pylist()[0]
        held = own.filter(pc.is_valid(own["lexeme"]))
        mine = pa.table({"chunk_id": pa.array([i for i in live if i in members], pa.int64())})
        for r in kept_index._unrolled(iter(kept_index._kept(held, mine).combine_chunks().to_batches())):
            got |= {(x["chunk_id"], x["lexeme"]): (x["places"], x["tf"]) for x in r.to_pylist()}
        found += kept_index._best_of(held, mine, batch.blocks(queries, "own"), 2).to_pylist()
    assert members == [i for i, _ in chunks] and rows["block"].combine_chunks().unique().to_pylist()[-1] == chunks[-1][0]
    assert got == {(i, w): ([p for p, x in enumerate(ws) if x == w], ws.count(w)) for i, ws in live.items() for w in set(ws)}
    for q, own in zip(queries["query_id"].to_pylist(), queries["own"].to_pylist(), strict=True):
        want = sorted((-len(set(own) & set(ws)) - min(0.25, 0.1 * sum(ws.count(w) for w in own)), i) for i, ws in live.items() if set(own) & set(ws))[:2]
        assert sorted((-r["shared"] - min(0.25, 0.1 * r["positions"]), r["chunk_id"]) for r in found if r["query_id"] == q)[:2] == want


def test_index_moves_lists_once(spark, tmp_path):
    """before, places were shuffled twice by an update, and a search joined each query, chunk and lexeme."""
    index = KeptIndex(CommitLog(spark, str(tmp_path / "log")), buckets=4)
    index.update(spark.createDataFrame(corpus(random.Random(4), 50), "chunk_id long, text string"))
    q = spark.createDataFrame([(1, "w1 w2")], "query_id long, text string")
    plan = index.search(q, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "places" not in plan.split("CoGroup")[0] and plan.count("Join") == 1
    index.update(gone=spark.createDataFrame([(3,)], "chunk_id long"))
    plan = index.postings()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CoGroup") == 1 and 3 not in {r.chunk_id for r in index.postings().collect()}
