"""SNK-11, SNK-12, ST-3, ST-4, PF-3, AG-3: the outbox as deterministic functions of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEASE_MINUTES, DEAD_AFTER, LONGEST = 5, 8, 300


def claimable(outbox: DataFrame, now: Column) -> DataFrame:
    ready = (F.col("status") == "pending") & (F.col("available_at") <= now)
    lost = (F.col("status") == "processing") & (F.col("locked_at") < now - F.expr(f"INTERVAL {LEASE_MINUTES} MINUTES"))
    return outbox.filter(ready | lost)


def claim(outbox: DataFrame, now: Column, batch: int = 10) -> DataFrame:
    """TK-7, JN-16: the first ``batch`` claimable commands by id, as processing."""
    picked = claimable(outbox, now).orderBy("outbox_id").limit(batch)
    return picked.withColumn("status", F.lit("processing")).withColumn("locked_at", now).withColumn("attempts", F.col("attempts") + 1)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempts), F.lit(float(LONGEST))).cast("long")


def failed(claimed: DataFrame, now: Column) -> DataFrame:
    """State after an error: pending again after a backoff, failed after eight attempts."""
    dead = F.col("attempts") >= DEAD_AFTER
    wait = F.make_dt_interval(secs=backoff_seconds(F.col("attempts")))
    return claimed.withColumn("status", F.when(dead, "failed").otherwise("pending")).withColumn("available_at", F.when(dead, F.col("available_at")).otherwise(now + wait)).withColumn("locked_at", F.lit(None).cast("timestamp"))


def reclaim(outbox: DataFrame, now: Column, most: int = 50) -> DataFrame:
    """SNK-12: failed for over 30 minutes, at most 50, attempts reset."""
    old = outbox.filter((F.col("status") == "failed") & (F.col("available_at") < now - F.expr("INTERVAL 30 MINUTES")))
    return old.orderBy("outbox_id").limit(most).withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))


def metrics(jobs: DataFrame, now: Column, waiting: list[str], broken: list[str], at: str = "created_at") -> DataFrame:
    """One row: pending, failed, age of the oldest pending in seconds."""
    is_waiting = F.col("status").isin(waiting)
    oldest = F.min(F.when(is_waiting, F.col(at)))
    age = F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(oldest.cast("timestamp"))) / 1_000_000.0, F.lit(0.0))
    return jobs.agg(F.count_if(is_waiting).alias("pending"), F.count_if(F.col("status").isin(broken)).alias("failed"), age.alias("oldest_pending_seconds"))
