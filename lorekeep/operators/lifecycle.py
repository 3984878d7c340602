"""Event log and fold: revisions, documents, facts, visibility (SNK-2 to SNK-13, FLT-1, WN-2, WN-3).

Nothing is updated in place.  Events are appended; current state is one
aggregate or window over a memory's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """WN-2, JN-11: the columns of each key's last row: an aggregate with map-side combine, no sort."""
    top = F.max(F.struct(*order, *[c for c in cols if c not in order])).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col("_top")[c].alias(c) for c in cols])


def revisions(events: DataFrame) -> DataFrame:
    """WN-3, SNK-8: activated revisions with state and times.

    events: memory_id, revision_id, activated_at, seq.  The last one a memory
    is active; others are superseded when the next one is activated."""
    w = Window.partitionBy("memory_id").orderBy("activated_at", "seq")
    out = events.withColumn("superseded_at", F.lead("activated_at").over(w)).withColumn("previous_id", F.lag("revision_id").over(w)).withColumn("version", F.row_number().over(w))
    return out.withColumn("state", F.when(F.col("superseded_at").isNull(), "active").otherwise("superseded"))


def heads(events: DataFrame) -> DataFrame:
    """SNK-2, SNK-3: documents from events (memory_id, seq, path, doc_status,
    mtime_ns, file_size, revision_id when activated): the last stated value of each column."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy("memory_id").agg(*[last(c) for c in ("path", "doc_status", "mtime_ns", "file_size", "revision_id")])


def visible(status: Column, current: Column, revision: Column, state: Column) -> Column:
    """FLT-1, current."""
    return (status == "active") & (current == revision) & (state == "active")


def historical(state: Column) -> Column:
    """FLT-1, historical: document status is not asked."""
    return state.isin("active", "superseded")


def new_revisions(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """SNK-2, ST-9: incoming content that its memory doesn't have yet; repeats in the batch collapse."""
    return incoming.dropDuplicates(["memory_id", "content_hash"]).join(known.select("memory_id", "content_hash").distinct(), ["memory_id", "content_hash"], "left_anti")


def changed_files(listing: DataFrame, seen: DataFrame, force: bool = False) -> DataFrame:
    """SRC-2, SRC-3: files whose time or size differ from what was last seen, that are new, or whose document was deleted."""
    old = seen.select(F.col("path").alias("_p"), F.col("mtime_ns").alias("_m"), F.col("file_size").alias("_s"), F.col("doc_status").alias("_d"))
    both = listing.join(old, F.col("path") == F.col("_p"), "left")
    same = F.col("_m").eqNullSafe(F.col("mtime_ns")) & F.col("_s").eqNullSafe(F.col("file_size")) & (F.coalesce("_d", F.lit("deleted")) != "deleted")
    return (both if force else both.filter(~same)).select(*listing.columns)


def missing(documents: DataFrame, seen: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """SNK-10, JN-18: documents not seen in a scan, to be marked deleted; none if a file failed without an id."""
    if failed is not None and failed.filter("memory_id is null").limit(1).count():
        return documents.limit(0)
    return documents.filter("doc_status <> 'deleted'").join(seen.select("memory_id").distinct(), "memory_id", "left_anti")


def first_names(mentions: DataFrame) -> DataFrame:
    """SNK-4: entities: the first name seen a key wins."""
    return mentions.groupBy("entity_key").agg(F.min_by("name", F.struct("seq", "name")).alias("canonical_name"))


def last_aliases(aliases: DataFrame) -> DataFrame:
    """SNK-5: an alias key belongs to its last writer; an alias equal to its own entity's key is skipped."""
    return aliases.filter("alias_key <> entity_key").groupBy("alias_key").agg(F.max_by("entity_key", F.struct("seq", "entity_key")).alias("entity_key"))


def resolved_claims(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """SNK-6: claims whose subject and object both are entities."""
    e = entities.select("entity_key").distinct()
    s, o = e.withColumnRenamed("entity_key", "subject"), e.withColumnRenamed("entity_key", "object")
    return claims.join(s, "subject", "left_semi").join(o, "object", "left_semi")


def facts(events: DataFrame) -> DataFrame:
    """SNK-7, SNK-8: facts (profile_id, fact_key, fact_value, at, seq) with validity; the last a key is active."""
    w = Window.partitionBy("profile_id", "fact_key").orderBy("at", "seq")
    out = events.withColumn("valid_from", F.col("at")).withColumn("valid_to", F.lead("at").over(w))
    return out.withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def as_of(rows: DataFrame, t: Column) -> DataFrame:
    """PF-7: rows valid at t."""
    return rows.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))


def delete_commands(deleted: DataFrame, outbox: DataFrame) -> DataFrame:
    """SNK-9, JN-17: delete commands to enqueue, unless one is pending or processing."""
    waiting = outbox.filter("command = 'delete_memory' and status in ('pending', 'processing')").select("memory_id").distinct()
    return deleted.join(waiting, "memory_id", "left_anti").withColumn("command", F.lit("delete_memory"))


def retained(rows: DataFrame, at: str, now: Column, keep: str, only: Column | None = None) -> DataFrame:
    """SNK-13, FLT-12: rows that survive a retention rule (older than ``keep`` and, if given, matching ``only`` goes)."""
    old = F.col(at) < now - F.expr(f"INTERVAL {keep}")
    return rows.filter(~F.coalesce(old & only if only is not None else old, F.lit(False)))


def embedded(vectors: DataFrame, dim: int) -> DataFrame:
    """SNK-14: fails on a vector of another length."""
    return vectors.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"vectors must have {dim} dimensions")).cast("array<float>")))


def without(vectors: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """SNK-14: vectors after deletion by (memory, revision), by memory, or by id."""
    return vectors.join(gone.select(*on).distinct(), on, "left_anti")


def with_chunks(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN-13: whether a document's current revision has a chunk, as a column."""
    has = chunks.select(F.col("revision_id").alias("_r")).distinct()
    return documents.join(has, F.col("current_revision_id") == F.col("_r"), "left").withColumn("has_chunks", F.col("_r").isNotNull()).drop("_r")


def payload(joined: DataFrame) -> DataFrame:
    """PRJ-14: a search result's payload: chunk id and a struct of what is served with it."""
    cols = ("memory_id", "revision_id", "memory_type", "source_file", "entity_keys", "text")
    return joined.select("chunk_id", F.struct(*[c for c in cols if c in joined.columns]).alias("payload"))
