"""Timed streams equal their batch forms over the same events, in any order of arrival within the watermark."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorekeep.streaming import timers

START = datetime(2024, 1, 1)


def streamed(spark, tmp_path, name, rows, schema, make, end):
    """Runs a stream over rows, one micro-batch for each list of rows; a last event of another key moves the watermark to the end."""
    folder = tmp_path / name
    cols = schema.split(", ")
    typed = lambda rs: spark.createDataFrame(rs, schema)
    for i, part in enumerate([*rows, [end]]):
        typed(part).coalesce(1).write.mode("append").parquet(str(folder / f"b{i:03d}"))
    stream = spark.readStream.schema(typed([end]).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder / "*"))
    assert len(cols) == len(stream.columns)
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name).collect()


def parts(rng, rows, n):
    """Rows by time, cut into n micro-batches."""
    cut = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]


def test_retries(spark, tmp_path):
    rng = random.Random(1)
    rows, at = [], START
    for _ in range(60):
        at += timedelta(seconds=rng.choice([1, 2, 3, 7, 20, 40]))
        rows.append((rng.choice("abc"), at, rng.random() < 0.3))
    schema = "path string, ts timestamp, ok boolean"
    batch = timers.retries(spark.createDataFrame(rows, schema))
    want = sorted((r.path, r.attempt, r.retry_at) for r in batch.filter("fired").collect())
    assert len(want) > 10 and batch.filter("attempt > 3 AND retry_at IS NOT NULL").count() == 0
    for r in batch.filter("attempt <= 3").collect():
        assert (r.retry_at - r.ts).total_seconds() == min(2**r.attempt, 30)
    got = streamed(spark, tmp_path, "retries", parts(rng, rows, 5), schema, timers.retry_stream, ("z", at + timedelta(hours=1), True))
    assert sorted((r.path, r.attempt, r.retry_at) for r in got if r.path != "z") == want


def test_leases(spark, tmp_path):
    t = lambda s: START + timedelta(seconds=s)
    rows = [(1, t(0), "claim"), (2, t(1), "claim"), (2, t(60), "done"), (3, t(2), "claim"), (1, t(400), "claim"), (1, t(450), "done"), (3, t(500), "done"), (4, t(600), "claim"), (4, t(700), "fail"), (4, t(710), "claim")]
    schema = "outbox_id long, ts timestamp, kind string"
    now = F.lit("2024-01-02").cast("timestamp")
    lost = sorted((r.outbox_id, r.attempt, r.lost_at) for r in timers.leases(spark.createDataFrame(rows, schema), now).collect())
    assert lost == [(1, 1, t(300)), (3, 1, t(302)), (4, 2, t(1010))]  # their workers are gone
    got = streamed(spark, tmp_path, "leases", [rows[:4], rows[4:7], rows[7:]], schema, timers.lease_stream, (9, t(7200), "claim"))
    each = [(r.outbox_id, r.status, r.attempts, r.at) for r in got if r.outbox_id != 9]
    assert sorted((i, n, at) for i, s, n, at in each if s == "pending" and (i, n, at) != (4, 1, t(700))) == lost
    last = {}
    for i, s, n, at in sorted(each, key=lambda x: x[3]):
        last[i] = (s, n)
    assert last == {1: ("succeeded", 2), 2: ("succeeded", 1), 3: ("pending", 1), 4: ("pending", 2)}


def test_order_of_shuffled_arrival(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), START + timedelta(milliseconds=1100 * i), i, f"p{i}") for i in range(80)]
    late = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.uniform(0, 8)))  # within ten seconds
    schema = "key string, ts timestamp, seq long, payload string"
    want = sorted((r.key, r.n, r.ts, r.seq, r.payload) for r in timers.in_order(spark.createDataFrame(rows, schema)).collect())
    got = streamed(spark, tmp_path, "ordered", parts(rng, late, 6), schema, timers.in_order, ("z", START + timedelta(hours=1), 0, "end"))
    assert sorted((r.key, r.n, r.ts, r.seq, r.payload) for r in got if r.key != "z") == want


def test_cache_against_a_plain_one(spark):
    rng = random.Random(3)
    rows, at = [], START
    for _ in range(600):
        at += timedelta(seconds=rng.choice([1, 5, 30]))
        rows.append((rng.choice("ab"), f"k{min(rng.randrange(40), rng.randrange(40))}", at))
    want = []
    for client in "ab":
        held: dict[str, tuple[datetime, datetime]] = {}  # key -> put, used
        for _, k, t in [r for r in rows if r[0] == client]:
            held = {x: v for x, v in held.items() if (t - v[0]).total_seconds() < 300}
            hit = k in held
            if not hit and len(held) >= 10:
                del held[min(held, key=lambda x: held[x][1])]
            held[k] = (held[k][0] if hit else t, t)
            want.append((client, k, t, hit))
    df = spark.createDataFrame(rows, "client string, key string, ts timestamp").repartition(5)
    got = sorted(map(tuple, timers.cache_hits(df, entries=10).collect()))
    assert got == sorted(want) and 0 < sum(x[3] for x in got) < len(got)
