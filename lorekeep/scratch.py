"""Scratch tables: how lineage is cut.

An intermediate result that is used again is written as a Parquet table under
the folder that the cluster names in ``spark.checkpoint.dir``.  Driver and
executors share it, so a lost executor never takes such rows with it.  Tables
go when ``discard`` is called, or when the application ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, SparkSession] = {}
_local: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder of the session.  Without one, a temporary folder where
    driver and executors are one process; an error where they are not, because
    the driver would read only its own share of what they write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lorekeep-"))
    return _local[0]


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a scratch table and returns a reader of it.

    The shuffle files of the job are removed when it ends, so that the disk
    holds one phase of an operator at a time.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/lorekeep/{tag}-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    _made[path] = spark
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing will read again; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path and (spark := _made.pop(path, None)) is not None:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clear() -> None:
    for path, spark in _made.items():
        with contextlib.suppress(Exception):  # the application may be gone already
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
