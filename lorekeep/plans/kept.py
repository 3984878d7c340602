"""Commits, the kept index, timers and the reranker.  Orders are revisions of their customer's memory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scores as S
from ..functions import text as T
from ..operators import batch, lexical, rerank, staging
from ..operators.kept_index import KeptIndex
from ..sources.commits import CommitLog
from ..streaming import timers
from .base import Tables, micros, query, stamp
from .retrieval import LEXICAL, TOKENS, chunks_of, lexical_top, queries_of


def _log(spark: SparkSession) -> CommitLog:
    return CommitLog(spark, f"{scratch.root(spark)}/lorekeep/log-{uuid.uuid4().hex}")


_SIDE = "SELECT o_custkey AS k, max(o_orderkey) AS r, arg_max(o_orderpriority, o_orderkey) AS h FROM orders WHERE o_orderstatus = '{}' GROUP BY 1"


@query(f"""
WITH f AS ({_SIDE.format('F')}), o AS ({_SIDE.format('O')}), p AS ({_SIDE.format('P')}),
j AS (SELECT k, f.r AS f, f.h AS fh, o.r AS o, o.h AS oh, p.r AS p, p.h AS ph FROM f FULL JOIN o USING (k) FULL JOIN p USING (k)),
s AS (SELECT *, o IS NOT NULL AND (fh IS NULL OR fh <> oh) AS o_new FROM j),
a AS (SELECT *, o_new AND o % 3 <> 0 AS o_act, CASE WHEN ph = fh THEN f WHEN o_new AND ph = oh THEN o END AS p_old FROM s),
c AS (SELECT *, CASE WHEN o_act THEN o ELSE f END AS current FROM a),
g AS (SELECT *, CASE WHEN p_old IS DISTINCT FROM current THEN p_old END AS again, p IS NOT NULL AND p_old IS NULL AS p_new FROM c)
SELECT k AS memory_id, current AS current_revision_id, f AS revision_id, CASE WHEN again = f THEN 'staged' WHEN o_act THEN 'superseded' ELSE 'active' END AS state FROM g WHERE f IS NOT NULL
UNION ALL SELECT k, current, o, CASE WHEN again = o OR NOT o_act THEN 'staged' ELSE 'active' END FROM g WHERE o_new
UNION ALL SELECT k, current, p, 'staged' FROM g WHERE p_new
""")
def lc_staged_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, SNK-8: three batches are staged and two activated, each in one commit; what readers then see."""
    t, log, now = Tables(spark, sf_dir), _log(spark), stamp("2024-01-31")
    for status in "FOP":
        own = t.orders.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("memory_id")).agg(F.max("o_orderkey").alias("revision_id"), F.max_by("o_orderpriority", "o_orderkey").alias("content_hash"))
        batch = own.withColumns({"path": F.concat(F.lit("p/"), F.col("memory_id").cast("string")), "doc_status": F.lit("active"), "mtime_ns": F.lit(None).cast("long"), "file_size": F.lit(None).cast("long")})
        staging.stage(log, batch, now)
        if status != "P":
            landed = staging.revisions(log).filter("state = 'staged'")
            staging.activate(log, landed if status == "F" else landed.filter("revision_id % 3 <> 0"), now)
    heads = staging.documents(log).select("memory_id", "current_revision_id")
    return heads.join(staging.revisions(log), "memory_id").select("memory_id", "current_revision_id", "revision_id", "state")


def _updated_index(t: Tables, log: CommitLog) -> KeptIndex:
    """An index after three updates: all documents in French and German; the rest, while German ones get the text of
    their source and language before their own; poor documents go."""
    index, d = KeptIndex(log, buckets=16), t.documents
    first = F.col("lang").isin("fr", "de")
    index.update(d.filter(first).select(F.col("doc_id").alias("chunk_id"), "text"))
    changed = d.filter("lang = 'de'").select(F.col("doc_id").alias("chunk_id"), F.concat_ws(" ", "source", "lang", "text").alias("text"))
    rest = d.filter(~F.coalesce(first, F.lit(False))).select(F.col("doc_id").alias("chunk_id"), "text")
    index.update(rest.unionByName(changed), changed.select("chunk_id"))
    index.update(gone=t.labels.filter("quality = 0").select(F.col("doc_id").alias("chunk_id")))
    return index


_UPDATED = """SELECT doc_id AS chunk_id, CASE WHEN lang = 'de' THEN concat_ws(' ', source, lang, text) ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"""


@query(f"""SELECT lexeme, count(*) AS chunks, sum(tf)::BIGINT AS tf, sum(last)::BIGINT AS last_places FROM (
  SELECT chunk_id, lexeme, count(*) AS tf, max(place) AS last FROM (SELECT chunk_id, generate_subscripts(ws, 1) - 1 AS place, unnest(ws) AS lexeme FROM (SELECT chunk_id, {TOKENS.format('text')} AS ws FROM ({_UPDATED}))) GROUP BY ALL) GROUP BY 1""")
def ix_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-1, SC-5: the kept index after updates and a merge is that of the documents as they then are."""
    index = _updated_index(Tables(spark, sf_dir), _log(spark))
    index.merge()
    p = index.postings()
    return p.groupBy("lexeme").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("tf"), F.sum(F.element_at("places", -1)).alias("last_places"))


@query(f"""WITH {LEXICAL.replace('FROM documents)', f'FROM (SELECT chunk_id AS doc_id, text FROM ({_UPDATED})))')} SELECT query_id, chunk_id, round(coverage, 6) AS coverage, strict, round(rank, 6) AS rank, pos FROM lx WHERE pos <= 5""")
def ix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-1, TK-1: a search of the kept index, from the rarest lexemes on: the exact five best."""
    t = Tables(spark, sf_dir)
    top = _updated_index(t, _log(spark)).search(queries_of(t), 5)
    return top.select("query_id", "chunk_id", F.round("coverage", 6).alias("coverage"), "strict", F.round("rank", 6).alias("rank"), F.col("pos").cast("long").alias("pos"))


@query("""
WITH e AS (SELECT user_id AS path, ts, event_type <> 'error' AS ok FROM events),
r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY path ORDER BY ts) AS run, lead(ts) OVER (PARTITION BY path ORDER BY ts) AS nxt FROM e),
n AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY path, run ORDER BY ts) AS attempt FROM r),
d AS (SELECT *, CASE WHEN attempt <= 3 THEN ts + INTERVAL 1 SECOND * CAST(least(pow(2, attempt), 30) AS BIGINT) END AS due FROM n WHERE NOT ok)
SELECT path, epoch_us(ts) AS at_us, attempt::INT AS attempt, epoch_us(due) AS retry_us, due IS NOT NULL AND (nxt IS NULL OR nxt > due) AS fired FROM d
""")
def st_timed_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: failed events of a user and when each runs again."""
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    return timers.retries(e).select("path", micros(F.col("ts")).alias("at_us"), "attempt", micros(F.col("retry_at")).alias("retry_us"), "fired")


@query("""
WITH e AS (SELECT user_id AS outbox_id, ts, event_type = 'click' AS claim FROM events WHERE event_type IN ('click', 'view', 'error')),
n AS (SELECT *, lead(ts) OVER (PARTITION BY outbox_id ORDER BY ts) AS nxt, sum(claim::INT) OVER (PARTITION BY outbox_id ORDER BY ts) AS attempt FROM e)
SELECT outbox_id, epoch_us(ts) AS claimed_us, attempt::INT AS attempt, epoch_us(ts + INTERVAL 5 MINUTE) AS lost_us FROM n WHERE claim AND coalesce(nxt, TIMESTAMP '2024-03-01') > ts + INTERVAL 5 MINUTE
""")
def st_lost_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3: claims (clicks) of a user's command without an answer (view or error) for five minutes."""
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "done").otherwise("fail")
    e = Tables(spark, sf_dir).events.filter(F.col("event_type").isin("click", "view", "error")).select(F.col("user_id").alias("outbox_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    return timers.leases(e, stamp("2024-03-01")).select("outbox_id", micros(F.col("claimed_at")).alias("claimed_us"), "attempt", micros(F.col("lost_at")).alias("lost_us"))


@query("SELECT key, at_us, processed FROM (SELECT user_id AS key, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS processed FROM events) WHERE processed % 10 = 0")
def st_count_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-7: after each ten events of a user a cycle runs."""
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    return timers.triggers(e).select("key", micros(F.col("ts")).alias("at_us"), "processed")


@query("SELECT user_id::VARCHAR AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id AS seq, event_type AS payload FROM events")
def st_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-8: each user's events one after the other."""
    e = Tables(spark, sf_dir).events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return timers.in_order(e).select("key", "n", "seq", "payload")


@query("""
WITH RECURSIVE r AS (SELECT user_id AS client, event_type AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events),
c AS (SELECT client, key, n, us, us AS put, false AS hit FROM r WHERE n = 1
  UNION ALL SELECT r.client, r.key, r.n, r.us, CASE WHEN r.us - c.put < 86400000000 THEN c.put ELSE r.us END, r.us - c.put < 86400000000 FROM c JOIN r ON r.client = c.client AND r.key = c.key AND r.n = c.n + 1)
SELECT client, key, us AS at_us, hit FROM c
""")
def st_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-11: requests (of event types by users) that a cache of a thousand entries a client and a day's life answers."""
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("client"), F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return timers.cache_hits(e, seconds=86_400.0).select("client", "key", micros(F.col("ts")).alias("at_us"), "hit")


@query(f"""WITH {LEXICAL}, x AS (SELECT query_id, chunk_id, pos, least(1.0, coverage) AS score,
  8.0::DOUBLE * len(list_intersect(list_distinct({TOKENS.format('q.text')}), {TOKENS.format('d.text')})) / greatest(len(list_distinct({TOKENS.format('q.text')})), 1) - 4 AS logit
  FROM lx JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE pos <= 20)
SELECT query_id, chunk_id, round(greatest(0, least(1, 0.6::DOUBLE / (1 + exp(-logit)) + 0.4::DOUBLE * score)), 6) AS score FROM x""")
def ret_model_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UX-7, RET-13: the twenty best of each query, scored anew by a pair model in batches."""
    t = Tables(spark, sf_dir)
    top = batch.beside(lexical_top(t, 20), chunks_of(t), "chunk_id").join(queries_of(t).withColumnRenamed("text", "query"), "query_id")
    logit = rerank.model_logits(rerank.overlap_model)(F.col("query"), F.col("text"))
    heuristic = S.heuristic_rerank(F.col("shared"), F.col("n"), F.length("text"))
    scored = top.withColumn("logit", logit).withColumn("coverage", F.least(F.lit(1.0), F.col("coverage")))
    return scored.select("query_id", "chunk_id", F.round(rerank.blended(F.col("coverage"), F.col("logit"), heuristic), 6).alias("score"))
