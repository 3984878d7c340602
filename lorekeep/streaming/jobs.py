"""ST-1 to ST-10: streaming forms, each equal to a batch fold over the same events, and the loops that drive them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import queues


def debounce(events: DataFrame, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """ST-1: (path, event_type) of the last event of each burst; works on batch and stream.

    events: path, ts, event_type.  Bursts are session windows per path; the
    watermark bounds the state."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.max_by("event_type", "ts").alias("event_type"), F.count(F.lit(1)).alias("events")).select("path", F.col("w.start").alias("first_ts"), (F.col("w.end") - F.expr(f"INTERVAL {gap}")).alias("last_ts"), "event_type", "events")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """ST-9: drops replays of (memory_id, content_hash); in a stream, within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["memory_id", "content_hash"])
    return events.dropDuplicates(["memory_id", "content_hash"])


def retry_at(at: Column, attempt: Column, most: int = 3, longest: int = 30) -> Column:
    """ST-2: when a failed event runs again: min(2^n, 30) seconds on; null after three attempts."""
    wait = F.make_dt_interval(secs=F.least(F.pow(F.lit(2.0), attempt), F.lit(float(longest))))
    return F.when(attempt < most, at + wait)


def outbox_fold(rows: DataFrame) -> DataFrame:
    """ST-3, ST-4, ST-8: status of each command after its attempts, as a stateful stream or a batch.

    rows: outbox_id, ts, ok.  Keyed state replaces leases: one task owns a command."""
    schema, state = "outbox_id long, status string, attempts int, available_at timestamp", "attempts int, done boolean"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        attempts, done = s.get if s.exists else (0, False)
        last = None
        for pdf in batches:
            for r in pdf.sort_values("ts").itertuples():
                if done or attempts >= queues.DEAD_AFTER:
                    continue
                attempts, done, last = attempts + 1, bool(r.ok), r.ts
        s.update((attempts, done))
        if last is not None:
            status = "succeeded" if done else "failed" if attempts >= queues.DEAD_AFTER else "pending"
            wait = 0 if status != "pending" else min(2**attempts, queues.LONGEST)
            yield pd.DataFrame({"outbox_id": [key[0]], "status": [status], "attempts": [attempts], "available_at": [last + pd.Timedelta(seconds=wait)]})

    return rows.groupBy("outbox_id").applyInPandasWithState(fold, schema, state, "update", GroupStateTimeout.NoTimeout)


def activate(stream: DataFrame, embed: Callable[[DataFrame], DataFrame], vectors_path: str, log_path: str, checkpoint: str) -> StreamingQuery:
    """Writes a batch's vectors, then logs the activation of exactly the
    revisions whose vectors landed: a revision is invisible until then.
    ``batch_id`` makes a replay overwrite its own files (idempotent)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        v = embed(batch)
        v.write.mode("overwrite").parquet(f"{vectors_path}/batch={batch_id}")
        landed = batch.sparkSession.read.parquet(f"{vectors_path}/batch={batch_id}").select("memory_id", "revision_id").distinct()
        landed.withColumn("event_type", F.lit("revision_activated")).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def every(n: int, action: Callable[[DataFrame, int], None], counter: str) -> Callable[[DataFrame, int], None]:
    """ST-7: a foreachBatch function that runs ``action`` after each n processed rows.

    The count is a table under ``counter``, one row a batch, so it outlives a
    restart; a batch that is replayed overwrites its own row and is counted once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = batch.agg(F.count(F.lit(1)).alias("rows"))
        seen.coalesce(1).write.mode("overwrite").parquet(f"{counter}/batch={batch_id}")
        rows = spark.read.schema("rows long, batch long").parquet(counter)
        before, after = rows.agg(F.coalesce(F.sum(F.when(F.col("batch") < batch_id, F.col("rows"))), F.lit(0)), F.sum(F.when(F.col("batch") <= batch_id, F.col("rows")))).first()
        if after // n > before // n:
            action(batch, batch_id)

    return each


def poll(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, idle: str = "1 second", reclaim: Callable[[], None] | None = None, reclaim_s: float = 300.0) -> StreamingQuery:
    """ST-5: the worker's loop: each batch of commands goes to ``work``, the next one is
    looked for after ``idle``; failed commands are reclaimed every ``reclaim_s`` seconds of the
    stream's clock."""
    last = [time.monotonic()]

    def each(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id)
        if reclaim is not None and time.monotonic() - last[0] >= reclaim_s:
            last[0] = time.monotonic()
            reclaim()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=idle).start()


def reconcile(spark: SparkSession, scan: Callable[[], DataFrame], apply: Callable[[DataFrame], None], checkpoint: str, each: str = "300 seconds") -> StreamingQuery:
    """ST-6: a full scan when the service starts, and one each 300 seconds after: what the
    change feed missed is applied then.  The ticks of a rate source are the clock."""
    apply(scan())
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, n: None if batch.isEmpty() else apply(scan())).option("checkpointLocation", checkpoint).trigger(processingTime=each).start()


def wait_for(query: StreamingQuery, seen: Callable[[], bool], timeout_s: float = 30.0, every_s: float = 0.2) -> bool:
    """ST-10: read after write: returns once ``seen`` is true, or false after the time.
    What the stream's source has by now is processed first."""
    end = time.monotonic() + timeout_s
    query.processAllAvailable()
    while not (done := seen()) and time.monotonic() < end:
        time.sleep(every_s)
    return done


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: tumbling activity counts with a watermark."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
