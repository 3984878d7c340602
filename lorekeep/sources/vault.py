"""SRC-1 to SRC-12: notes, graphs, golden queries and profiles as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that a scan skips.
SKIPPED = (".git", ".obsidian", ".trash", "node_modules", "__pycache__", ".venv")


def note_path(path: Column) -> Column:
    """SRC-1, FLT-10: a note that a scan takes: *.md, outside hidden or skipped folders, no dot or backup file."""
    skipped = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    return path.endswith(".md") & ~path.rlike(rf"(^|/)({skipped})/") & ~path.rlike(r"(^|/)\.[^/]*") & ~path.contains(".backup-")


def daily_note(path: Column) -> Column:
    """SRC-12."""
    return path.startswith("Daily/") & path.endswith(".md") & ~path.endswith("/README.md")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """SRC-1, SRC-5: (path, raw, mtime_ns, file_size) of the notes under a folder."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    path = F.element_at(F.split("path", base, -1), -1)
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("raw"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("file_size")).filter(note_path(F.col("path")))


def change_feed(spark: SparkSession, root: str) -> DataFrame:
    """SRC-4: a stream of new and changed notes (Spark keeps the list of files seen)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return files.select("path", F.col("modificationTime").alias("ts"), F.decode("content", "UTF-8").alias("raw"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """SRC-4, batch: (path, event_type, seq) between two listings (path, content_hash).

    A path that is new and has the content of one that is gone has been moved: its new
    path comes first (``moved_to``), then the old one (``moved_from``).  If several have that
    content, they are paired in order of their paths; the rest is created or deleted."""
    b, a = before.filter(note_path(F.col("path"))), after.filter(note_path(F.col("path")))
    old, new = b.join(a.select("path"), "path", "left_anti"), a.join(b.select("path"), "path", "left_anti")
    kept = b.withColumnRenamed("content_hash", "_was").join(a, "path").filter(~F.col("_was").eqNullSafe(F.col("content_hash")))
    numbered = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy("content_hash").orderBy("path")))
    pairs = numbered(new).select("content_hash", "_n", F.col("path").alias("_to")).join(numbered(old).select("content_hash", "_n", F.col("path").alias("_from")), ["content_hash", "_n"])
    to, from_ = pairs.select(F.col("_to").alias("path")), pairs.select(F.col("_from").alias("path"))
    parts = [
        (kept, "modified", 0), (new.join(to, "path", "left_anti"), "created", 0), (old.join(from_, "path", "left_anti"), "deleted", 0),
        (to, "moved_to", 0), (from_, "moved_from", 1),
    ]
    rows = [d.select("path", F.lit(kind).alias("event_type"), F.lit(seq).alias("seq")) for d, kind, seq in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def golden_queries(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9."""
    schema = "queries array<struct<id:string,query:string,expected_sources:array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-10: nodes and links of a node-link file."""
    schema = "nodes array<struct<id:string,type:string,label:string>>, links array<struct<source:string,target:string,relation:string>>"
    g = spark.read.schema(schema).option("multiLine", True).json(path)
    return g.select(F.explode("nodes").alias("n")).select("n.*"), g.select(F.explode("links").alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"), "l.relation")


def identity_versions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: (entity_id, version_number, trait_id, confidence)."""
    schema = "entity_id string, version_number int, traits_snapshot map<string,struct<confidence:double>>"
    v = spark.read.schema(schema).json(path)
    return v.select("entity_id", "version_number", F.explode("traits_snapshot").alias("trait_id", "t")).select("entity_id", "version_number", "trait_id", "t.confidence")


def revision_chunks(chunks: DataFrame, documents: DataFrame, revisions: DataFrame, mentions: DataFrame) -> DataFrame:
    """SRC-7, JN-1, JN-4: chunks with their document, revision and distinct entity keys (aggregated once, then joined)."""
    keys = mentions.groupBy("revision_id").agg(F.sort_array(F.collect_set("entity_key")).alias("entity_keys"))
    out = chunks.join(revisions.select("revision_id", "state", "project", "source_agent"), "revision_id").join(documents.select("memory_id", "memory_type", "doc_status", "current_revision_id"), "memory_id")
    return out.join(keys, "revision_id", "left").withColumn("entity_keys", F.coalesce("entity_keys", F.array().cast("array<string>")))


def export_active(joined: DataFrame) -> DataFrame:
    """SRC-8: active chunks of current revisions, in order, for a new embedding."""
    return joined.filter("doc_status = 'active' and state = 'active' and current_revision_id = revision_id").orderBy("memory_id", "ordinal")


def projection_state(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-6: distinct (memory, revision) pairs and the number of points; rows without both ids are skipped in the pairs."""
    return points.dropna(subset=["memory_id", "revision_id"]).select("memory_id", "revision_id").distinct(), points.agg(F.count(F.lit(1)).alias("points"))
