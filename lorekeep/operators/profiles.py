"""PF-1, PF-2, PF-7, RET-7: profiles, facts and memory status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lifecycle import latest

#: Parts of a profile's facts that are joined by a task each.
SALTS = 32


def profile_facts(profiles: DataFrame, facts: DataFrame, documents: DataFrame, historical: bool = False) -> DataFrame:
    """PF-1, JN-10, TK-8: facts of profiles with evidence in a current revision; order is by key, newest first."""
    d = documents.filter("doc_status = 'active'").select(F.col("memory_id").alias("evidence_memory_id"), F.col("current_revision_id").alias("evidence_revision_id"))
    keep = facts.filter(F.col("status").isin(["active"] + ["superseded"] * historical))
    if not historical:
        keep = keep.join(d, ["evidence_memory_id", "evidence_revision_id"], "left_semi")
    return profiles.join(keep, "profile_id").orderBy("profile_id", "fact_key", F.desc("valid_from"))


def profile_boosts(queries: DataFrame, profiles: DataFrame, facts: DataFrame, documents: DataFrame, boost: float = 0.08) -> DataFrame:
    """RET-7, JN-8, FLT-8: memories that are evidence for a profile whose key is in the query text or among its entity keys.

    ``queries``: query_id, query_key (normalised text), entity_keys.  Keys are
    matched by their words: an equi-join on the key's first word, then the
    literal containment test, so no query meets every profile.

    A profile that many queries name has its facts dealt over SALTS tasks.  A
    memory that is evidence for several profiles of a query comes with the
    least of them, so the pairs found need no aggregate."""
    word = F.explode(F.array_distinct(F.split("query_key", " ")))
    q = queries.select("query_id", "query_key", "entity_keys", word.alias("w"))
    p = profiles.select("profile_id", "canonical_key", F.split("canonical_key", " ")[0].alias("w"))
    inside = q.join(p, "w").filter(F.col("query_key").contains(F.col("canonical_key"))).select("query_id", "profile_id")
    listed = queries.select("query_id", F.explode("entity_keys").alias("canonical_key")).join(profiles.select("profile_id", "canonical_key"), "canonical_key").select("query_id", "profile_id")
    d = documents.filter("doc_status = 'active'").select(F.col("memory_id").alias("evidence_memory_id"), F.col("current_revision_id").alias("evidence_revision_id"))
    f = facts.filter("status = 'active'").join(d, ["evidence_memory_id", "evidence_revision_id"], "left_semi")
    hit = inside.unionByName(listed).distinct()
    named = hit.groupBy("query_id").agg(F.collect_list("profile_id").alias("named"))
    each = hit.join(named, "query_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = f.groupBy("evidence_memory_id").agg(F.collect_set("profile_id").alias("own"))
    held = own.select("evidence_memory_id", "own", F.explode("own").alias("profile_id"), F.pmod(F.xxhash64("evidence_memory_id"), F.lit(SALTS)).cast("int").alias("salt"))
    first = held.join(each, ["profile_id", "salt"]).filter(F.col("profile_id") == F.array_min(F.array_intersect("own", "named")))
    return first.select("query_id", F.col("evidence_memory_id").alias("memory_id"), F.lit(boost).alias("profile_boost"))


def memory_status(documents: DataFrame, revisions: DataFrame, jobs: DataFrame, outbox: DataFrame) -> DataFrame:
    """PF-2, JN-11: latest revision, job and outbox row of each document, and its index status.

    Three aggregates on the key stand for the three lateral top-1 queries."""
    r = latest(revisions, ["memory_id"], ["created_at", "revision_id"], ["revision_id", "state"]).select("memory_id", F.col("revision_id").alias("latest_revision_id"), F.col("state").alias("revision_state"))
    j = latest(jobs, ["memory_id"], ["created_at", "job_id"], ["status"]).select("memory_id", F.col("status").alias("job_status"))
    o = latest(outbox, ["memory_id"], ["outbox_id"], ["status"]).select("memory_id", F.col("status").alias("outbox_status"))
    out = documents.join(r, "memory_id", "left").join(j, "memory_id", "left").join(o, "memory_id", "left")
    true = lambda c: F.coalesce(c, F.lit(False))
    indexed = true((F.col("current_revision_id") == F.col("latest_revision_id")) & (F.col("revision_state") == "active") & (F.col("doc_status") == "active"))
    failed = true(F.col("job_status") == "failed") | true(F.col("outbox_status") == "failed")
    return out.withColumn("index_status", F.when(indexed, "indexed").when(failed, "failed").otherwise("pending"))


def owner_type(path: Column) -> Column:
    """SNK-7: the kind of profile that a note's first folder makes."""
    from ..functions import vocab

    first = F.substring_index(path, "/", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in vocab.PROFILE_FOLDERS.items() for x in kv]), first)
