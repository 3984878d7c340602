"""Lifecycle and queues.  Orders are revisions of their customer's memory, events are jobs and outbox rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions.vectors import norm, routed
from ..operators import lifecycle as L
from ..operators import profiles, queues, readiness
from ..sources import vault
from ..streaming import jobs as J
from .base import Tables, micros, query, stamp

NOW = "2024-01-31"


def revisions_of(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("memory_id"), F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("activated_at"), F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_totalprice")


CHAIN = """r AS (SELECT o_custkey AS memory_id, o_orderkey AS revision_id, o_orderdate AS activated_at,
  lead(o_orderdate) OVER w AS superseded_at, lag(o_orderkey) OVER w AS previous_id, row_number() OVER w AS version,
  CASE WHEN lead(o_orderdate) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS state, o_totalprice
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


@query(f"WITH {CHAIN} SELECT memory_id, revision_id, epoch_us(superseded_at) AS superseded_us, previous_id, version, state FROM r")
def lc_revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-3, WN-4, SNK-8."""
    r = L.revisions(revisions_of(Tables(spark, sf_dir)))
    return r.select("memory_id", "revision_id", micros(F.col("superseded_at")).alias("superseded_us"), "previous_id", F.col("version").cast("long").alias("version"), "state")


@query("SELECT o_custkey AS memory_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS revision_id, max(o_totalprice) AS dummy FROM orders GROUP BY 1")
def lc_current_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-2, JN-16, DML fold: the last revision a memory, as an aggregate."""
    t = Tables(spark, sf_dir)
    top = L.latest(revisions_of(t), ["memory_id"], ["activated_at", "revision_id"], ["revision_id"])
    return top.join(t.orders.groupBy(F.col("o_custkey").alias("memory_id")).agg(F.max("o_totalprice").alias("dummy")), "memory_id")


@query(f"""WITH {CHAIN} SELECT memory_id, revision_id, round(o_totalprice, 2) AS price FROM r JOIN customer ON c_custkey = memory_id WHERE state = 'active' AND c_acctbal >= 0""")
def lc_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, JN-5, JN-14: active documents (customers in credit), current and active revisions."""
    t = Tables(spark, sf_dir)
    r = L.revisions(revisions_of(t))
    d = t.customer.select(F.col("c_custkey").alias("memory_id"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("archived").alias("doc_status"))
    both = r.join(d, "memory_id").withColumn("current", F.when(F.col("state") == "active", F.col("revision_id")))
    return both.filter(L.visible(F.col("doc_status"), F.col("current"), F.col("revision_id"), F.col("state"))).select("memory_id", "revision_id", F.round("o_totalprice", 2).alias("price"))


@query(f"WITH {CHAIN} SELECT memory_id, count(*) AS n FROM r WHERE state IN ('active', 'superseded') GROUP BY 1")
def lc_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, historical: no document check."""
    r = L.revisions(revisions_of(Tables(spark, sf_dir)))
    return r.filter(L.historical(F.col("state"))).groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT user_id AS memory_id, arg_max('p/' || event_type, event_id) AS path, arg_max(CASE event_type WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'archived' WHEN 'signup' THEN 'active' END, CASE WHEN event_type IN ('error', 'purchase', 'signup') THEN event_id END) AS doc_status,
       arg_max(CAST(round(value * 100) AS BIGINT), CASE WHEN value < 100 THEN event_id END) AS file_size
FROM events GROUP BY 1
""")
def lc_document_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SNK-3: the last stated value of each column."""
    kind = F.col("event_type")
    e = Tables(spark, sf_dir).events.select(
        F.col("user_id").alias("memory_id"), F.col("event_id").alias("seq"), F.concat(F.lit("p/"), kind).alias("path"),
        F.when(kind == "error", "deleted").when(kind == "purchase", "archived").when(kind == "signup", "active").alias("doc_status"),
        F.lit(None).cast("long").alias("mtime_ns"), F.when(F.col("value") < 100, F.round(F.col("value") * 100).cast("long")).alias("file_size"), F.lit(None).cast("long").alias("revision_id"),
    )
    return L.heads(e).select("memory_id", "path", "doc_status", "file_size")


@query("""
WITH r AS (SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS rid, arg_max(CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'staged' ELSE 'superseded' END, (o_orderdate, o_orderkey)) AS st FROM orders GROUP BY 1),
j AS (SELECT user_id AS k, arg_max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'succeeded' END, (ts, event_id)) AS js FROM events GROUP BY 1),
o AS (SELECT user_id AS k, arg_max(CASE WHEN value > 150 THEN 'failed' ELSE 'succeeded' END, event_id) AS os FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT c_custkey AS memory_id, rid AS latest_revision_id, st AS revision_state, js AS job_status, os AS outbox_status,
       CASE WHEN coalesce(st = 'active' AND c_acctbal >= 0, false) THEN 'indexed' WHEN coalesce(js = 'failed', false) OR coalesce(os = 'failed', false) THEN 'failed' ELSE 'pending' END AS index_status
FROM customer LEFT JOIN r ON r.k = c_custkey LEFT JOIN j ON j.k = c_custkey LEFT JOIN o ON o.k = c_custkey
""")
def pf_memory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF-2, JN-11, JN-15."""
    t = Tables(spark, sf_dir)
    state = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "staged").otherwise("superseded")
    r = revisions_of(t).select("memory_id", "revision_id", state.alias("state"), F.col("activated_at").alias("created_at"))
    kind = F.col("event_type")
    e = t.events.select(F.col("user_id").alias("memory_id"), "event_id", "ts", "event_type", "value")
    jobs = e.select("memory_id", F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.when(kind == "error", "failed").when(kind == "signup", "pending").otherwise("succeeded").alias("status"))
    box = e.filter("event_type <> 'view'").select("memory_id", F.col("event_id").alias("outbox_id"), F.when(F.col("value") > 150, "failed").otherwise("succeeded").alias("status"))
    d = t.customer.select(F.col("c_custkey").alias("memory_id"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("archived").alias("doc_status"))
    current = L.latest(r, ["memory_id"], ["created_at", "revision_id"], ["revision_id"]).withColumnRenamed("revision_id", "current_revision_id")
    out = profiles.memory_status(d.join(current, "memory_id", "left"), r, jobs, box)
    return out.select("memory_id", "latest_revision_id", "revision_state", "job_status", "outbox_status", "index_status")


@query("SELECT doc_id AS path FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 0 OR toxic = 1")
def src_incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SRC-3: labels stand for what was seen: poor ones have another size, toxic ones were deleted."""
    t = Tables(spark, sf_dir)
    listing = t.documents.select(F.col("doc_id").alias("path"), F.col("doc_id").alias("mtime_ns"), F.col("n_chars").alias("file_size"))
    seen = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("path"), F.col("doc_id").alias("mtime_ns"), (F.col("n_chars") + 1 - F.col("quality")).alias("file_size"), F.when(F.col("toxic") == 1, "deleted").otherwise("active").alias("doc_status"))
    return L.changed_files(listing, seen).select("path")


@query("SELECT count(*) FILTER (WHERE q IS NULL) AS created, count(*) FILTER (WHERE q = 0) AS updated, count(*) FILTER (WHERE q = 1) AS unchanged, count(*) AS total FROM (SELECT quality AS q FROM documents LEFT JOIN labels USING (doc_id))")
def src_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-8."""
    t = Tables(spark, sf_dir)
    q = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return q.agg(F.count_if(F.col("quality").isNull()).alias("created"), F.count_if(F.col("quality") == 0).alias("updated"), F.count_if(F.col("quality") == 1).alias("unchanged"), F.count(F.lit(1)).alias("total"))


@query("SELECT doc_id AS memory_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lc_mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10, JN-18."""
    t = Tables(spark, sf_dir)
    d = t.documents.select(F.col("doc_id").alias("memory_id"), F.lit("active").alias("doc_status"))
    return L.missing(d, t.labels.select(F.col("doc_id").alias("memory_id"))).select("memory_id")


@query("SELECT source AS memory_id, count(DISTINCT sha256(text)) AS n FROM documents WHERE (source, sha256(text)) NOT IN (SELECT source, sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def lc_new_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, ST-9: labelled documents are known content of their source."""
    t = Tables(spark, sf_dir)
    d = t.documents.select("doc_id", F.col("source").alias("memory_id"), F.sha2("text", 256).alias("content_hash"))
    return L.new_revisions(d, d.join(t.labels, "doc_id", "left_semi")).groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(p_brand) AS entity_key, arg_min(p_name, (p_partkey, p_name)) AS canonical_name FROM part GROUP BY 1")
def lc_first_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-4."""
    return L.first_names(Tables(spark, sf_dir).part.select(F.lower("p_brand").alias("entity_key"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq")))


@query("SELECT lower(p_name) AS alias_key, arg_max(lower(p_brand), (p_partkey, lower(p_brand))) AS entity_key FROM part WHERE lower(p_name) <> lower(p_brand) GROUP BY 1")
def lc_last_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-5."""
    return L.last_aliases(Tables(spark, sf_dir).part.select(F.lower("p_name").alias("alias_key"), F.lower("p_brand").alias("entity_key"), F.col("p_partkey").alias("seq")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def lc_resolved_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6: entities are large parts and suppliers in credit."""
    t = Tables(spark, sf_dir)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t.part.filter("p_size > 25").select(name("p", "p_partkey").alias("entity_key")).unionByName(t.supplier.filter("s_acctbal > 0").select(name("s", "s_suppkey").alias("entity_key")))
    c = t.lineitem.select("l_orderkey", "l_linenumber", name("p", "l_partkey").alias("subject"), name("s", "l_suppkey").alias("object"))
    return L.resolved_claims(c, e).select("l_orderkey", "l_linenumber")


FACTS = """f AS (SELECT o_custkey AS profile_id, o_orderpriority AS fact_key, o_orderstatus AS fact_value, o_orderkey AS seq, o_orderdate AS valid_from,
  lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders)"""


def facts_of(t: Tables) -> DataFrame:
    return L.facts(t.orders.select(F.col("o_custkey").alias("profile_id"), F.col("o_orderpriority").alias("fact_key"), F.col("o_orderstatus").alias("fact_value"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq")))


@query(f"WITH {FACTS} SELECT profile_id, fact_key, fact_value, seq FROM f WHERE valid_to IS NULL")
def lc_active_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-7, SNK-8: facts are orders by customer and priority."""
    return facts_of(Tables(spark, sf_dir)).filter("status = 'active'").select("profile_id", "fact_key", "fact_value", "seq")


@query(f"WITH {FACTS} SELECT profile_id, fact_key, fact_value, seq FROM f WHERE valid_from <= TIMESTAMP '1997-01-01' AND (valid_to IS NULL OR TIMESTAMP '1997-01-01' < valid_to)")
def pf_facts_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF-7."""
    return L.as_of(facts_of(Tables(spark, sf_dir)), F.lit("1997-01-01").cast("timestamp_ntz")).select("profile_id", "fact_key", "fact_value", "seq")


@query(f"WITH {FACTS} SELECT c_name AS name, fact_key, fact_value, seq, epoch_us(valid_from) AS from_us FROM f JOIN customer ON c_custkey = profile_id WHERE valid_to IS NULL AND c_acctbal >= 0")
def pf_profile_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF-1, JN-10, TK-8."""
    t = Tables(spark, sf_dir)
    f = facts_of(t).withColumn("evidence_memory_id", F.col("profile_id")).withColumn("evidence_revision_id", F.col("profile_id"))
    d = t.customer.select(F.col("c_custkey").alias("memory_id"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("archived").alias("doc_status"), F.col("c_custkey").alias("current_revision_id"))
    p = t.customer.select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("name"))
    return profiles.profile_facts(p, f, d).select("name", "fact_key", "fact_value", "seq", micros(F.col("valid_from")).alias("from_us"))


def outbox_of(t: Tables) -> DataFrame:
    """Events as outbox rows: errors failed, sign-ups wait, clicks are in work since their time."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "signup", "pending").when(kind == "click", "processing").otherwise("succeeded")
    command = F.when(F.col("value") > 100, "delete_memory").otherwise("upsert_revision")
    ts = F.col("ts").cast("timestamp")
    return t.events.select(F.col("event_id").alias("outbox_id"), F.col("user_id").alias("memory_id"), status.alias("status"), command.alias("command"), ts.alias("available_at"), ts.alias("locked_at"), ts.alias("created_at"), (F.col("event_id") % 10).cast("int").alias("attempts"))


BOX = """b AS (SELECT event_id AS outbox_id, user_id AS memory_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' ELSE 'succeeded' END AS status,
  CASE WHEN value > 100 THEN 'delete_memory' ELSE 'upsert_revision' END AS command, ts, CAST(event_id % 10 AS INT) AS attempts FROM events)"""


@query(f"WITH {BOX} SELECT DISTINCT c_custkey AS memory_id, 'delete_memory' AS command FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT memory_id FROM b WHERE command = 'delete_memory' AND status IN ('pending', 'processing'))")
def lc_delete_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-9, JN-17."""
    t = Tables(spark, sf_dir)
    return L.delete_commands(t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("memory_id")), outbox_of(t))


@query(f"WITH {BOX} SELECT outbox_id FROM b WHERE NOT (ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND status = 'succeeded')")
def lc_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13, FLT-12: done outbox rows go after seven days."""
    b = outbox_of(Tables(spark, sf_dir))
    return L.retained(b, "created_at", stamp(NOW), "7 DAYS", F.col("status") == "succeeded").select("outbox_id")


@query(f"WITH {BOX} SELECT outbox_id, 'processing' AS status, attempts + 1 AS attempts FROM b WHERE (status = 'pending' AND ts <= TIMESTAMP '2024-01-15') OR (status = 'processing' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 5 MINUTE) ORDER BY outbox_id LIMIT 10")
def q_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11, ST-3, TK-7: a lease of ten commands."""
    return queues.claim(outbox_of(Tables(spark, sf_dir)), stamp("2024-01-15")).select("outbox_id", "status", "attempts")


@query(f"WITH {BOX} SELECT outbox_id, CASE WHEN attempts >= 8 THEN 'failed' ELSE 'pending' END AS status, epoch_us(CASE WHEN attempts >= 8 THEN ts ELSE TIMESTAMP '{NOW}' + INTERVAL 1 SECOND * CAST(least(pow(2, attempts), 300) AS BIGINT) END) AS available_us FROM b WHERE status = 'processing'")
def q_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-4, SNK-11."""
    b = queues.failed(outbox_of(Tables(spark, sf_dir)).filter("status = 'processing'"), stamp(NOW))
    return b.select("outbox_id", "status", micros(F.col("available_at")).alias("available_us"))


@query(f"WITH {BOX} SELECT outbox_id, 'pending' AS status, 0::INT AS attempts FROM b WHERE status = 'failed' AND ts < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE ORDER BY outbox_id LIMIT 50")
def q_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12."""
    return queues.reclaim(outbox_of(Tables(spark, sf_dir)), stamp(NOW)).select("outbox_id", "status", "attempts")


@query(f"""WITH {BOX} SELECT count(*) FILTER (WHERE status IN ('pending', 'processing')) AS pending, count(*) FILTER (WHERE status = 'failed') AS failed,
round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(ts) FILTER (WHERE status IN ('pending', 'processing')))) / 1000000.0::DOUBLE, 3) AS oldest_pending_seconds FROM b""")
def pf_queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF-3, AG-3."""
    m = queues.metrics(outbox_of(Tables(spark, sf_dir)), stamp(NOW), ["pending", "processing"], ["failed"])
    return m.withColumn("oldest_pending_seconds", F.round("oldest_pending_seconds", 3))


@query("""
WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
SELECT user_id AS path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(event_type, ts) AS event_type, count(*) AS events FROM s GROUP BY user_id, burst
""")
def st_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1: bursts of a user with gaps under an hour (batch form of the stream)."""
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return J.debounce(e, "1 hour").select("path", micros(F.col("first_ts")).alias("first_us"), micros(F.col("last_ts")).alias("last_us"), "event_type", "events")


@query("SELECT source AS memory_id, md5(text) AS content_hash, count(*) > 0 AS seen FROM documents GROUP BY 1, 2")
def st_idempotent_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-9."""
    d = Tables(spark, sf_dir).documents.select(F.col("source").alias("memory_id"), F.md5("text").alias("content_hash"))
    return J.once(d).withColumn("seen", F.lit(True))


@query("SELECT event_id, epoch_us(CASE WHEN event_id % 5 < 3 THEN ts + INTERVAL 1 SECOND * CAST(least(pow(2, event_id % 5), 30) AS BIGINT) END) AS retry_us FROM events WHERE event_type = 'error'")
def st_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2."""
    e = Tables(spark, sf_dir).events.filter("event_type = 'error'")
    return e.select("event_id", micros(J.retry_at(F.col("ts").cast("timestamp"), F.col("event_id") % 5)).alias("retry_us"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows."""
    e = Tables(spark, sf_dir).events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return J.activity(e).select(micros(F.col("start")).alias("start_us"), "event_type", "n")


@query("""
WITH d AS (SELECT doc_id FROM documents), l AS (SELECT doc_id FROM labels), e AS (SELECT vec_id FROM embeddings)
SELECT (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS source_missing_in_store, (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM d)) AS store_missing_source,
  (SELECT count(*) FROM l WHERE doc_id NOT IN (SELECT vec_id FROM e)) AS vectors_missing, (SELECT count(*) FROM e WHERE vec_id NOT IN (SELECT doc_id FROM l)) AS vectors_stale,
  (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT vec_id FROM e)) AS points_missing, (SELECT count(*) FROM e WHERE vec_id NOT IN (SELECT doc_id FROM d)) AS points_stale,
  (SELECT count(*) FROM labels WHERE toxic = 1) AS malformed, abs((SELECT count(*) FROM e) - (SELECT count(*) FROM d)) AS point_count_delta
""")
def pf_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF-4, PF-5, JN-28, AG-9, SET-4: documents are the source, labels the store, embeddings the vectors."""
    t = Tables(spark, sf_dir)
    d, lab, e = (t.documents.select(F.col("doc_id").alias("i")), t.labels.select(F.col("doc_id").alias("i")), t.embeddings.select(F.col("vec_id").alias("i")))
    m = lambda x: x.select(F.col("i").alias("memory_id"), F.col("i").alias("revision_id"), F.col("i").alias("point_id"))
    return readiness.drift(m(d), m(lab), m(lab), m(e), m(d), m(e), t.labels.filter("toxic = 1")).drop("total")


@query("SELECT vec_id AS point_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pf_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan points (SNK-14's counterpart)."""
    t = Tables(spark, sf_dir)
    return readiness.orphans(t.embeddings.select(F.col("vec_id").alias("point_id")), t.labels.filter("quality = 1").select(F.col("doc_id").alias("point_id")))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'not_ready' WHEN c_acctbal < 0 THEN 'degraded' ELSE 'ready' END AS light, c_nationkey <> 0 AND c_acctbal >= 0 AND c_nationkey < 20 AS deep FROM customer")
def pf_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF-5, PF-6: each customer is a state of the system."""
    up, broken = F.col("c_nationkey") != 0, (F.col("c_acctbal") < 0).cast("int")
    deep = readiness.ready(up, F.lit(0), broken, (F.col("c_nationkey") >= 20).cast("int"))
    return Tables(spark, sf_dir).customer.select("c_custkey", readiness.light_status(up, broken).alias("light"), deep.alias("deep"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND label <> 3")
def lc_vectors_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14: deletion by id and by memory (label)."""
    t = Tables(spark, sf_dir)
    v = L.embedded(t.embeddings.select("vec_id", F.col("embedding").alias("vec"), "label"), 64)
    v = L.without(v, t.labels.filter("toxic = 1").select(F.col("doc_id").alias("vec_id")), ["vec_id"])
    return L.without(v, spark.range(3, 4).select(F.col("id").cast("int").alias("label")), ["label"]).filter(F.size("vec") == 64).select("vec_id")


@query("SELECT doc_id, coalesce(len(embedding), 64)::INT AS n, coalesce(round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4), 0) AS norm FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def lc_routed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-16."""
    t = Tables(spark, sf_dir)
    v = t.documents.select("doc_id").join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left").select("doc_id", routed(F.col("embedding"), 64).alias("vec"))
    return v.select("doc_id", F.size("vec").alias("n"), F.round(norm(F.col("vec")), 4).alias("norm"))


@query("SELECT label AS memory_id, count(*) AS points, count(DISTINCT vec_id) AS ids FROM embeddings GROUP BY 1")
def src_vector_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6."""
    return Tables(spark, sf_dir).embeddings.groupBy(F.col("label").alias("memory_id")).agg(F.count(F.lit(1)).alias("points"), F.count_distinct("vec_id").alias("ids"))


@query(f"""WITH {CHAIN}, k AS (SELECT o_custkey AS m, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS keys FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT l_orderkey AS revision_id, l_linenumber AS ordinal, coalesce(keys, '') AS entity_keys FROM lineitem JOIN r ON r.revision_id = l_orderkey JOIN customer ON c_custkey = r.memory_id LEFT JOIN k ON k.m = r.memory_id WHERE state = 'active' AND c_acctbal >= 0""")
def src_revision_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7, SRC-8, JN-1, JN-4, AG-4: line items are the chunks of their order."""
    t = Tables(spark, sf_dir)
    r = L.revisions(revisions_of(t)).select("memory_id", "revision_id", "state").withColumn("project", F.lit(None).cast("string")).withColumn("source_agent", F.lit(None).cast("string"))
    head = r.filter("state = 'active'").select("memory_id", F.col("revision_id").alias("current_revision_id"))
    d = t.customer.select(F.col("c_custkey").alias("memory_id"), F.lit("semantic").alias("memory_type"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("archived").alias("doc_status")).join(head, "memory_id")
    chunks = t.lineitem.select(F.col("l_orderkey").alias("revision_id"), F.col("l_linenumber").alias("ordinal")).join(r.select("revision_id", "memory_id"), "revision_id")
    keys = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("m"), F.col("o_orderpriority").alias("entity_key"))
    mentions = r.select("memory_id", "revision_id").join(keys, F.col("memory_id") == F.col("m")).select("revision_id", "entity_key")
    out = vault.export_active(vault.revision_chunks(chunks, d, r, mentions))
    return out.select("revision_id", "ordinal", F.array_join("entity_keys", ",").alias("entity_keys"))


@query("""WITH p AS (SELECT 'a/b/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.backup-1.md' ELSE '.md' END AS path FROM documents UNION ALL SELECT '.git/' || doc_id || '.md' FROM labels UNION ALL SELECT 'Daily/' || doc_id || '.md' FROM labels UNION ALL SELECT 'Daily/README.md')
SELECT path, starts_with(path, 'Daily/') AND NOT ends_with(path, '/README.md') AS daily FROM p WHERE ends_with(path, '.md') AND NOT starts_with(path, '.git/') AND NOT contains(path, '.backup-')""")
def src_vault_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1, SRC-5, SRC-12, FLT-10, TK-13."""
    t = Tables(spark, sf_dir)
    i = F.col("doc_id").cast("string")
    end = F.when(F.col("doc_id") % 4 == 1, ".txt").when(F.col("doc_id") % 4 == 2, ".backup-1.md").otherwise(".md")
    p = t.documents.select(F.concat(F.lit("a/b/"), i, end).alias("path"))
    for head in (".git/", "Daily/"):
        p = p.unionByName(t.labels.select(F.concat(F.lit(head), i, F.lit(".md")).alias("path")))
    p = p.unionByName(spark.range(1).select(F.lit("Daily/README.md").alias("path")))
    return p.filter(vault.note_path(F.col("path"))).select("path", vault.daily_note(F.col("path")).alias("daily"))


@query("SELECT o_orderkey AS memory_id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_chunks FROM orders")
def pf_has_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13, PF-4."""
    t = Tables(spark, sf_dir)
    d = t.orders.select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderkey").alias("current_revision_id"))
    return L.with_chunks(d, t.lineitem.select(F.col("l_orderkey").alias("revision_id"))).select("memory_id", "has_chunks")


@query("SELECT doc_id AS chunk_id, source AS memory_type, 'f' || doc_id AS source_file, length(text) AS n FROM documents")
def ret_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-14."""
    d = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("memory_type"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("source_file"), "text")
    return L.payload(d).select("chunk_id", "payload.memory_type", "payload.source_file", F.length("payload.text").cast("long").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'conflict' WHEN contains(p_name, 'red') THEN 'edited' ELSE 'not_found' END AS outcome,
CASE WHEN p_size % 3 <> 0 AND contains(p_name, 'red') THEN left(p_name, instr(p_name, 'red') - 1) || 'blue' || substr(p_name, instr(p_name, 'red') + 3) ELSE p_name END AS text,
p_name || chr(10) || chr(10) || '[[' || p_brand || ']]' || chr(10) AS linked, 'Archive/' || p_name AS archived FROM part""")
def lc_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-18."""
    from ..operators import writing as W

    n = F.col("p_name")
    expected = F.when(F.col("p_size") % 3 == 0, "stale").otherwise(F.sha2(n, 256))
    e = Tables(spark, sf_dir).part.select("p_partkey", W.edit(n, F.lit("red"), F.lit("blue"), expected).alias("e"), W.add_link(n, F.col("p_brand")).alias("linked"), W.archived_path(n).alias("archived"))
    return e.select("p_partkey", "e.outcome", "e.text", "linked", "archived")


@query("SELECT s_suppkey, upper(s_name) AS agent FROM supplier WHERE s_nationkey IN (1, 2, 3)")
def lc_allowed_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AX-1, FLT-2: an allow-list matched without case."""
    from ..operators import lexical

    t = Tables(spark, sf_dir)
    agents = [f"nation_{i}" for i in (1, 2, 3)]
    chunks = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("source_agent", F.lower("n_name"))
    return lexical.filtered(chunks, agents=agents).select("s_suppkey", F.upper("s_name").alias("agent"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS first, label AS collection FROM embeddings WHERE label <> 0")
def snk_served_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, SNK-15, SNK-16: two versions of a vector set; the alias points at the second."""
    from ..sources import sinks

    e = Tables(spark, sf_dir).embeddings.select("vec_id", F.col("embedding").alias("vec"), F.col("label").alias("collection"))
    home = f"{scratch.root(spark)}/lorekeep/vectors-{uuid.uuid4().hex}"
    for version, rows in (("1", e), ("2", e.filter("collection <> 0"))):
        sinks.switch(spark, f"{home}/alias.json", sinks.write_vectors(rows, home, version, 64))
    return sinks.served(spark, f"{home}/alias.json").select("vec_id", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("first"), F.col("collection").cast("int").alias("collection"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def snk_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-19: rows appended in two writes."""
    from ..sources import sinks

    e = Tables(spark, sf_dir).events.select("event_id", "event_type")
    log = f"{scratch.root(spark)}/lorekeep/log-{uuid.uuid4().hex}"
    for kind in ("click", "error"):
        sinks.append(e.filter(F.col("event_type") == kind), log)
    return spark.read.parquet(log)


@query("SELECT DISTINCT 'n' || s_nationkey AS src, 'p' || ps AS dst, 'uses' AS relation FROM (SELECT s_nationkey, l_partkey % 100 AS ps FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)")
def snk_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-21, SRC-10: links written as JSON lines and read again."""
    from ..sources import sinks

    t = Tables(spark, sf_dir)
    e = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") % 100).cast("string")).alias("dst"), F.lit("uses").alias("relation")).distinct()
    path = f"{scratch.root(spark)}/lorekeep/graph-{uuid.uuid4().hex}"
    sinks.graph_json(e.select(F.col("src").alias("node")).distinct(), e, path)
    return spark.read.schema("src string, dst string, relation string").json(f"{path}/links")


@query("SELECT o_custkey % 200 AS entity_id, (o_orderkey % 3 + 1)::INT AS version_number, o_orderpriority AS trait_id, round(avg(o_totalprice) / 500000, 4) AS confidence FROM orders GROUP BY 1, 2, 3")
def src_identity_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: versions as JSON, a map of traits each, read as rows."""
    o = Tables(spark, sf_dir).orders
    key = [(F.col("o_custkey") % 200).cast("string").alias("entity_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("version_number")]
    v = o.groupBy(*key, "o_orderpriority").agg(F.struct(F.round(F.avg("o_totalprice") / 500000, 4).alias("confidence")).alias("t"))
    path = f"{scratch.root(spark)}/lorekeep/versions-{uuid.uuid4().hex}"
    v.groupBy("entity_id", "version_number").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "t"))).alias("traits_snapshot")).write.json(path)
    return vault.identity_versions(spark, path).withColumn("entity_id", F.col("entity_id").cast("long"))


@query("SELECT item_id::VARCHAR AS id, text AS query, 'doc' || item_id AS source FROM benchmark")
def src_golden_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9: golden queries, a file each, with their expected sources."""
    b = Tables(spark, sf_dir).benchmark
    i = F.col("item_id").cast("string")
    case = F.struct(i.alias("id"), F.col("text").alias("query"), F.array(F.concat(F.lit("doc"), i)).alias("expected_sources"))
    path = f"{scratch.root(spark)}/lorekeep/golden-{uuid.uuid4().hex}"
    cases = b.groupBy((F.col("item_id") % 4).alias("part")).agg(F.collect_list(case).alias("queries"))
    cases.write.partitionBy("part").json(path)
    return vault.golden_queries(spark, path).select("id", "query", F.explode("expected_sources").alias("source"))
