"""SNK-1, SNK-15, SNK-16, SNK-19, SNK-21: atomic writes, versioned vector sets, exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import routed


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """SNK-19: appends rows as immutable files; the committer makes them visible at once."""
    w = df.write.mode("append")
    (w.partitionBy(*by) if by else w).parquet(path)


def replace_file(spark: SparkSession, path: str, content: str) -> None:
    """SNK-1: a file's new content, durable and all at once: written beside it, synced, and renamed over it.

    Readers see the old content or the new, on any file system whose rename
    is atomic."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
        out.hsync()
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


def write_vectors(vectors: DataFrame, root: str, version: str, dim: int) -> str:
    """SNK-15, SNK-16: a new version of the vector set, by collection; missing vectors are zeros."""
    path = f"{root.rstrip('/')}/version={version}"
    vectors.withColumn("vec", routed(F.col("vec"), dim)).write.mode("errorifexists").partitionBy("collection").parquet(path)
    return path


def switch(spark: SparkSession, alias: str, path: str) -> None:
    """SNK-15: points an alias (a small file that all readers share) at a version.
    It is replaced atomically, so a reader sees the old set or the new one, never a mix."""
    spark.read.parquet(path).schema  # a version that cannot be read is no target
    replace_file(spark, alias, json.dumps({"path": path}))


def served(spark: SparkSession, alias: str) -> DataFrame:
    """SNK-15: the version that an alias points at now."""
    target = spark.read.schema("path string").json(alias).first()
    return spark.read.parquet(target["path"])


def graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK-21: nodes and links as JSON lines under two folders."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def merge_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-21: a graph database's statements, one a row (``seq``: nodes come first): merges of
    nodes (node) and of edges (src, dst, relation); quotes and backslashes escaped."""
    text = lambda c: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "'", r"\\'"), F.lit("'"))
    kind = F.upper(F.regexp_replace(F.col("relation"), "[^A-Za-z0-9]+", "_"))
    n = nodes.select(F.lit(0).alias("seq"), F.concat(F.lit("MERGE (:Entity {name: "), text(F.col("node")), F.lit("})")).alias("statement"))
    e = F.concat(F.lit("MATCH (a:Entity {name: "), text(F.col("src")), F.lit("}), (b:Entity {name: "), text(F.col("dst")), F.lit("}) MERGE (a)-[:"), kind, F.lit("]->(b)"))
    return n.unionByName(edges.select(F.lit(1).alias("seq"), e.alias("statement")))


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Graph</title></head><body><table id="links"></table><script>
const links = %s;
for (const [src, relation, dst] of links) {
  const row = document.getElementById("links").insertRow();
  for (const cell of [src, relation, dst]) row.insertCell().textContent = cell;
}
</script></body></html>
"""


def graph_html(edges: DataFrame, path: str, most: int = 10_000) -> None:
    """SNK-21: a page that shows a (bounded) graph's links, replaced atomically.

    A page is for eyes: more than ``most`` edges are an error; choose a
    neighbourhood first."""
    rows = edges.select("src", "relation", "dst").orderBy("src", "dst", "relation").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges; export a neighbourhood")
    data = json.dumps([list(r) for r in rows], ensure_ascii=False).replace("</", "<\\/")
    replace_file(edges.sparkSession, path, PAGE % data)
