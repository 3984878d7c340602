"""PF-4 to PF-6, JN-28, AG-9, EV-1, EV-2, AG-10: drift between projections, readiness, retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(source_ids: DataFrame, stored_ids: DataFrame, expected: DataFrame, vectors: DataFrame, expected_points: DataFrame, points: DataFrame, malformed: DataFrame) -> DataFrame:
    """PF-5: one row of counters and their total.  ids: memory_id; pairs: memory_id, revision_id; points: point_id."""
    minus = lambda a, b, on: a.select(*on).distinct().join(b.select(*on).distinct(), on, "left_anti")
    m, p, t = ["memory_id"], ["memory_id", "revision_id"], ["point_id"]
    parts = {
        "source_missing_in_store": minus(source_ids, stored_ids, m),
        "store_missing_source": minus(stored_ids, source_ids, m),
        "vectors_missing": minus(expected, vectors, p),
        "vectors_stale": minus(vectors, expected, p),
        "points_missing": minus(expected_points, points, t),
        "points_stale": minus(points, expected_points, t),
        "malformed": malformed,
        "_points": points.select("point_id"),
        "_expected": expected_points.select("point_id"),
    }
    counts = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        counts = one if counts is None else counts.unionByName(one)
    row = counts.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in parts])
    row = row.withColumn("point_count_delta", F.abs(F.col("_points") - F.col("_expected"))).drop("_points", "_expected")
    return row.withColumn("total", sum((F.col(c) for c in row.columns[1:]), F.col(row.columns[0])))


def ready(components_ok: Column, pending: Column, failed: Column, total: Column) -> Column:
    """PF-5."""
    return components_ok & (pending == 0) & (failed == 0) & (total == 0)


def light_status(stores_up: Column, failures: Column) -> Column:
    """PF-6."""
    return F.when(~stores_up, "not_ready").when(failures > 0, "degraded").otherwise("ready")


def orphans(vectors: DataFrame, expected: DataFrame) -> DataFrame:
    """Points without a current chunk."""
    return vectors.join(expected.select("point_id"), "point_id", "left_anti")


def evaluate(results: DataFrame, expected: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """EV-1, JN-29: a row a query: hit1, hit5, reciprocal rank, leaks (results outside ``visible``).

    results: query_id, pos, source_file (memory_id, revision_id for leaks);
    expected: query_id, source_file."""
    e = expected.select("query_id", "source_file").distinct()
    found = results.join(e, ["query_id", "source_file"], "left_semi").groupBy("query_id").agg(F.min("pos").alias("rank"))
    out = e.select("query_id").distinct().join(found, "query_id", "left")
    out = out.select("query_id", F.coalesce(F.col("rank") <= 1, F.lit(False)).alias("hit1"), F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("hit5"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    if visible is None:
        return out.withColumn("leaks", F.lit(0).cast("long"))
    leaks = results.join(visible.select("memory_id", "revision_id").distinct(), ["memory_id", "revision_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("leaks"))
    return out.join(leaks, "query_id", "left").fillna(0, ["leaks"])


def summary(cases: DataFrame, *more: Column) -> DataFrame:
    """AG-10, with further aggregates if given."""
    return cases.agg(F.avg(F.col("hit1").cast("double")).alias("hit1"), F.avg(F.col("hit5").cast("double")).alias("hit5"), F.avg("reciprocal_rank").alias("mrr"), F.sum("leaks").alias("leaks"), F.count(F.lit(1)).alias("cases"), *more)


def gate(summary_: DataFrame, hit1: float = 0.8, hit5: float = 0.9) -> DataFrame:
    """EV-2."""
    return summary_.withColumn("passed", (F.col("hit1") >= hit1) & (F.col("hit5") >= hit5) & (F.col("leaks") == 0))
