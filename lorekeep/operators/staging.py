"""SNK-2, SNK-8: batches of parsed revisions are staged, and later activated, each in one commit over all tables.

Tables are event logs, so a commit only appends; what is current is a fold
over a memory's events (``documents``, ``revisions``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.commits import CommitLog
from . import lifecycle

#: Tables whose rows belong to a revision (memory_id and revision_id among their columns).
PARTS = ("chunks", "mentions", "claims", "facts")
_DOCUMENT = "memory_id long, seq long, path string, doc_status string, mtime_ns long, file_size long, revision_id long"
_REVISION = "memory_id long, revision_id long, content_hash string, state string, seq long"


def _folded(events: DataFrame | None, log: CommitLog, shape: str, fold) -> DataFrame:
    return fold(log.spark.createDataFrame([], shape) if events is None else events)


def _documents(events: DataFrame) -> DataFrame:
    return lifecycle.heads(events).withColumnRenamed("revision_id", "current_revision_id")


def _revisions(events: DataFrame) -> DataFrame:
    return lifecycle.latest(events, ["memory_id", "revision_id"], ["seq"], ["seq", "state", "content_hash"]).drop("seq")


def documents(log: CommitLog, version: int | None = None) -> DataFrame:
    """Documents of a version: the last stated value of each column, and the current revision."""
    return _folded(log.read("document_events", version), log, _DOCUMENT, _documents)


def revisions(log: CommitLog, version: int | None = None) -> DataFrame:
    """(memory_id, revision_id, state, content_hash) of a version."""
    return _folded(log.read("revision_events", version), log, _REVISION, _revisions)


def stage(log: CommitLog, batch: DataFrame, at: Column, parts: dict[str, DataFrame] | None = None) -> int:
    """Stages a batch (memory_id, revision_id, path, doc_status, mtime_ns, file_size, content_hash; one row a memory).

    In one commit: documents are upserted (null times and sizes keep what was
    there); content that a memory does not have becomes a staged revision with
    its rows of ``parts``, a pending job, a vector command and an audit row;
    known content that is not current, or whose document was deleted, is staged
    again with a new job and command; known, current content only updates its
    document.  Active revisions stay what they are.  If another commit has
    changed documents or revisions meanwhile, it raises Conflict and nothing
    has changed; the batch may be staged again."""
    tx = log.begin()
    seq = F.lit(tx.base.version + 1).cast("long")
    mine = batch.select("memory_id")
    only = lambda events: None if events is None else events.join(mine, "memory_id", "left_semi")
    known = _folded(only(tx.read("revision_events")), log, _REVISION, _revisions)
    now = _folded(only(tx.read("document_events")), log, _DOCUMENT, _documents).select("memory_id", "current_revision_id", F.col("doc_status").alias("was"))
    rows = batch.select("memory_id", "revision_id", "content_hash")
    old = known.select("memory_id", "content_hash", F.col("revision_id").alias("old_id"))
    same = rows.drop("revision_id").join(old, ["memory_id", "content_hash"]).join(now, "memory_id")
    again = same.filter(~F.col("old_id").eqNullSafe(F.col("current_revision_id")) | (F.col("was") == "deleted")).select("memory_id", F.col("old_id").alias("revision_id"), "content_hash")
    new = lifecycle.new_revisions(rows, known)
    staged = new.unionByName(again)
    tx.append("revision_events", staged.select("memory_id", "revision_id", "content_hash", F.lit("staged").alias("state"), seq.alias("seq")))
    tx.append("document_events", batch.select("memory_id", seq.alias("seq"), "path", "doc_status", "mtime_ns", "file_size", F.lit(None).cast("long").alias("revision_id")))
    for name, df in (parts or {}).items():
        if name not in PARTS:
            raise ValueError(f"not a part of a revision: {name}")
        tx.append(name, df.join(new.select("memory_id", "revision_id"), ["memory_id", "revision_id"], "left_semi"))
    log_row = lambda d, kind: d.select("memory_id", "revision_id", F.lit(kind).alias("event_type"), at.alias("at"))
    tx.append("jobs", log_row(staged, "upsert").withColumn("status", F.lit("pending")))
    tx.append("outbox", staged.select(F.lit("upsert_revision").alias("command"), "memory_id", "revision_id", at.alias("at")))
    tx.append("audit", log_row(new, "revision_staged").unionByName(log_row(again, "revision_restaged")))
    return tx.commit()


def activate(log: CommitLog, landed: DataFrame, at: Column) -> int:
    """SNK-8: the staged revisions (memory_id, revision_id) whose vectors have landed, in one commit: the last of a
    memory becomes current, the others and its active one superseded, and the document points at it."""
    tx = log.begin()
    seq = F.lit(tx.base.version + 1).cast("long")
    tx.read("document_events")
    ids = landed.select("memory_id", "revision_id").distinct()
    events = tx.read("revision_events")
    events = None if events is None else events.join(ids.select("memory_id").distinct(), "memory_id", "left_semi")
    own = _folded(events, log, _REVISION, _revisions).join(ids.withColumn("_landed", F.lit(True)), ["memory_id", "revision_id"], "left")
    own = own.filter("state = 'active' OR (state = 'staged' AND _landed)")
    last = own.filter("state = 'staged'").groupBy(F.col("memory_id").alias("_m")).agg(F.max("revision_id").alias("_new"))
    after = own.join(last, F.col("memory_id") == F.col("_m")).withColumn("state", F.when(F.col("revision_id") == F.col("_new"), "active").otherwise("superseded"))
    tx.append("revision_events", after.select("memory_id", "revision_id", "content_hash", "state", seq.alias("seq")))
    none = {c: F.lit(None).cast(k) for c, k in (("path", "string"), ("doc_status", "string"), ("mtime_ns", "long"), ("file_size", "long"))}
    now = after.filter("state = 'active'").select("memory_id", "revision_id")
    tx.append("document_events", now.withColumns({**none, "seq": seq}).select("memory_id", "seq", *none, "revision_id"))
    tx.append("audit", now.select("memory_id", "revision_id", F.lit("revision_activated").alias("event_type"), at.alias("at")))
    return tx.commit()
