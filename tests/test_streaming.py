"""Streams equal batch folds over the same events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.streaming import jobs as J


def run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def events(spark, tmp_path, rows, schema):
    batch = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))


def test_debounce(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "create"), ("a", "2024-01-01 00:00:01", "modify"), ("a", "2024-01-01 00:00:09", "delete"), ("b", "2024-01-01 00:00:00", "create"), ("z", "2024-01-02 00:00:00", "late")]
    batch, stream = events(spark, tmp_path, rows, "path string, ts string, event_type string")
    run(J.debounce(stream), "debounced", "append")
    got = sorted((r.path, r.event_type, r.events) for r in spark.table("debounced").collect())
    want = sorted((r.path, r.event_type, r.events) for r in J.debounce(batch).collect())
    assert want == [("a", "delete", 1), ("a", "modify", 2), ("b", "create", 1), ("z", "late", 1)]
    assert got == [x for x in want if x[0] != "z"]  # the last window is still open


def test_replay_is_idempotent(spark, tmp_path):
    rows = [(1, "h", "2024-01-01 00:00:00"), (1, "h", "2024-01-01 00:00:05"), (2, "h", "2024-01-01 00:00:01")]
    batch, stream = events(spark, tmp_path, rows, "memory_id long, content_hash string, ts string")
    run(J.once(stream).select("memory_id", "content_hash"), "once", "append")
    assert sorted(map(tuple, spark.table("once").collect())) == sorted((r.memory_id, r.content_hash) for r in J.once(batch).collect()) == [(1, "h"), (2, "h")]


def test_outbox(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", False), (1, "2024-01-01 00:01:00", True), (2, "2024-01-01 00:00:00", False)] + [(3, f"2024-01-01 00:{i:02d}:00", False) for i in range(9)]
    _, stream = events(spark, tmp_path, rows, "outbox_id long, ts string, ok boolean")
    run(J.outbox_fold(stream), "outbox", "update")
    got = {r.outbox_id: (r.status, r.attempts, str(r.available_at)) for r in spark.table("outbox").collect()}
    assert got == {1: ("succeeded", 2, "2024-01-01 00:01:00"), 2: ("pending", 1, "2024-01-01 00:00:02"), 3: ("failed", 8, "2024-01-01 00:07:00")}


def test_activation_follows_vectors(spark, tmp_path):
    rows = [(1, 10, "2024-01-01 00:00:00"), (2, 20, "2024-01-01 00:00:00")]
    _, stream = events(spark, tmp_path, rows, "memory_id long, revision_id long, ts string")
    embed = lambda b: b.filter("memory_id = 1").withColumn("vec", F.array(F.lit(1.0)))  # noqa: E731  one revision fails to embed
    q = J.activate(stream, embed, str(tmp_path / "v"), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert [(r.memory_id, r.revision_id, r.event_type) for r in log.select("memory_id", "revision_id", "event_type").collect()] == [(1, 10, "revision_activated")]


def test_every_counts_over_restarts_and_replays(spark, tmp_path):
    ran = []
    for i in (0, 1, 2, 2, 3, 4):
        J.every(10, lambda b, i: ran.append(i), str(tmp_path / "n"))(spark.range(4), i)  # each time a new process, so to say
    assert ran == [2, 2, 4]


def test_loops(spark, tmp_path):
    rows = [(1, "h", "2024-01-01 00:00:00"), (2, "h", "2024-01-01 00:00:05")]
    _, stream = events(spark, tmp_path, rows, "memory_id long, content_hash string, ts string")
    did, again = [], []
    q = J.poll(stream, lambda b, n: did.extend(r.memory_id for r in b.collect()), str(tmp_path / "cp"), "100 milliseconds", lambda: again.append(1), 0.0)
    assert J.wait_for(q, lambda: sorted(did) == [1, 2]) and again
    assert not J.wait_for(q, lambda: False, 0.1, 0.05)
    q.stop()
    scans = []
    r = J.reconcile(spark, lambda: spark.range(3), lambda d: scans.append(d.count()), str(tmp_path / "cp2"), "1 second")
    assert scans[0] == 3
    assert J.wait_for(r, lambda: len(scans) > 1)
    r.stop()
