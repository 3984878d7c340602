"""Session defaults: UTC, adaptive execution, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lorekeep", cpus: int | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators expect; ``cpus`` gives a local master."""
    b = SparkSession.builder.appName(name)
    if cpus:
        b = b.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**conf, **(extra or {})}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
