"""Retrieval: benchmark passages are the queries, documents the chunks, embeddings the vectors.

Embeddings have no key into documents; vec_id stands for doc_id and item_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import udfs
from ..functions.vectors import cosine
from ..operators import compress as C
from .. import scratch
from ..operators import batch, dense, fusion, legacy, lexical, profiles, readiness, vector_index, writing
from .base import Tables, query, stamp

TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
LEXICAL = f"""
qt AS (SELECT item_id AS query_id, len(list_distinct({TOKENS.format('text')})) AS n, unnest(list_distinct({TOKENS.format('text')})) AS lexeme FROM benchmark),
p AS (SELECT doc_id AS chunk_id, lexeme, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS lexeme FROM documents) GROUP BY ALL),
h AS (SELECT query_id, chunk_id, n, count(*) AS shared, sum(tf) AS positions FROM qt JOIN p USING (lexeme) GROUP BY ALL),
m AS (SELECT query_id, chunk_id, shared / n AS coverage, shared = n AS strict,
             shared / n + CASE WHEN shared = n THEN 0.25::DOUBLE ELSE 0 END + least(0.25::DOUBLE, 0.1::DOUBLE * positions) AS rank FROM h),
lx AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, strict DESC, rank DESC, chunk_id) AS pos FROM m)
"""
DENSE = """
qv AS (SELECT item_id AS query_id, e.embedding AS qe FROM benchmark JOIN embeddings e ON e.vec_id = item_id),
ds AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(qe::DOUBLE[], embedding::DOUBLE[]) AS score FROM qv, embeddings),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM ds)
"""
PASSAGE, STRIDE = 64, 32
_SIGNS = "SELECT *, CASE WHEN (h // 256) % 2 = 0 THEN 1 ELSE -1 END AS s, h % 256 AS b FROM (SELECT *, ('0x' || left(md5(lexeme), 8))::BIGINT AS h FROM ({0}))"
#: The words' embedder over benchmark items and passages of documents: signed hashed counts, and their cosines.
SEMANTIC = f"""
ws AS (SELECT doc_id, regexp_extract_all(text, '[^\\s]+') AS ws FROM documents),
ps AS (SELECT doc_id * 1000000 + (p - 1) // {STRIDE} AS vec_id, array_to_string(ws[p:p + {PASSAGE - 1}], ' ') AS text FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {STRIDE}) + 1, {STRIDE})) AS p FROM ws)),
pv AS (SELECT vec_id, b, sum(s)::DOUBLE AS v FROM ({_SIGNS.format(f"SELECT vec_id, unnest({TOKENS.format('text')}) AS lexeme FROM ps")}) GROUP BY ALL),
qv AS (SELECT item_id AS query_id, b, sum(s)::DOUBLE AS v FROM ({_SIGNS.format(f"SELECT item_id, unnest({TOKENS.format('text')}) AS lexeme FROM benchmark")}) GROUP BY ALL),
pn AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM pv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY 1),
dt AS (SELECT query_id, vec_id, sum(qv.v * pv.v) AS d FROM qv JOIN pv USING (b) GROUP BY 1, 2),
sc AS (SELECT query_id, vec_id, round(coalesce(d, 0) / qn.n / pn.n, 9) AS score FROM dt JOIN qn USING (query_id) JOIN pn USING (vec_id) WHERE qn.n > 0 AND pn.n > 0),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS p FROM sc),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM (SELECT query_id, vec_id // 1000000 AS chunk_id, max(score) AS score FROM sp WHERE p <= 20 GROUP BY 1, 2))
"""
FUSED = f"""{LEXICAL}, {SEMANTIC},
ls AS (SELECT query_id, 'lexical' AS source, chunk_id, pos, rank AS score FROM lx WHERE pos <= 20
       UNION ALL SELECT query_id, 'semantic', chunk_id, pos, score FROM dn),
fu AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + pos) ORDER BY source DESC) AS rrf, max(score) FILTER (WHERE source = 'semantic') AS semantic,
              max(score) FILTER (WHERE source = 'lexical') AS lexical, min(pos) AS best_pos, count(DISTINCT source) AS n_lists,
              string_agg(source, ',' ORDER BY source) AS rank_sources FROM ls GROUP BY ALL)
"""
BASE = """
(0.40::DOUBLE * rrf / max(rrf) OVER (PARTITION BY query_id)
 + 0.40::DOUBLE * greatest(CASE WHEN semantic IS NULL THEN 0 ELSE greatest(0, least(1, semantic)) END, CASE WHEN lexical IS NULL THEN 0 ELSE greatest(0.5, least(1, lexical)) END)
 + 0.20::DOUBLE * (n_lists / 2))
"""
RECENCY = "CASE WHEN {0} IS NULL THEN 0 ELSE round(0.15::DOUBLE * pow(2.0, -(greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us({0})) / 86400000000.0)) / 14), 4) END"


def queries_of(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def chunks_of(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text")


def vectors_of(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").alias("vec"), "label")


def lexical_top(t: Tables, k: int) -> DataFrame:
    return batch.search(queries_of(t), chunks_of(t), k)


def passages_of(t: Tables) -> DataFrame:
    """Documents as overlapping runs of words, numbered within their document."""
    words = T.split_words(F.col("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - STRIDE - 1), F.lit(STRIDE))
    each = t.documents.select("doc_id", words.alias("ws")).select("doc_id", "ws", F.posexplode(starts).alias("n", "p"))
    return each.select((F.col("doc_id") * 1_000_000 + F.col("n")).alias("vec_id"), F.array_join(F.slice("ws", F.col("p") + 1, F.lit(PASSAGE)), " ").alias("text"))


def semantic_top(t: Tables, k: int) -> DataFrame:
    """(query_id, chunk_id, score, pos): the documents of the k passages nearest to a query by the words' embedder."""
    near = dense.dense_search(queries_of(t), passages_of(t), k, udfs.hashed_embeddings)
    best = near.groupBy("query_id", F.floor(F.col("vec_id") / 1_000_000).alias("chunk_id")).agg(F.max("score").alias("score"))
    return lexical.top_k(best, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def dense_top(t: Tables, k: int) -> DataFrame:
    q = t.benchmark.join(vectors_of(t), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "vec")
    return dense.dense_search(q, vectors_of(t), k)


def fused(t: Tables, top: DataFrame | None = None) -> DataFrame:
    """Both legs' lists, fused; ``top``: the lexical one, if it has been made."""
    top = lexical_top(t, 20) if top is None else top
    lex = top.select("query_id", F.lit("lexical").alias("source"), "chunk_id", "pos", F.col("rank").alias("score"))
    sem = semantic_top(t, 20).select("query_id", F.lit("semantic").alias("source"), "chunk_id", "pos", "score")
    return fusion.fuse(lex.unionByName(sem))


@query(f"WITH {LEXICAL} SELECT query_id, chunk_id, round(coverage, 6) AS coverage, strict, round(rank, 6) AS rank, pos FROM lx WHERE pos <= 5")
def ret_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-1, TK-1, WN-1, WN-9, SC-5 to SC-7, FLT-5, SET-3, JN-1 to JN-3."""
    top = lexical_top(Tables(spark, sf_dir), 5)
    return top.select("query_id", "chunk_id", F.round("coverage", 6).alias("coverage"), "strict", F.round("rank", 6).alias("rank"), F.col("pos").cast("long").alias("pos"))


@query(f"WITH {LEXICAL} SELECT query_id, chunk_id FROM m WHERE strict")
def ret_lexical_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5: chunks that hold all lexemes of a query."""
    t = Tables(spark, sf_dir)
    return batch.strict(queries_of(t), chunks_of(t))


@query(f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 5) AS score, pos FROM dn WHERE pos <= 5")
def ret_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-2, TK-2, SC-11."""
    return dense_top(Tables(spark, sf_dir), 5).select("query_id", F.col("vec_id").alias("chunk_id"), F.round("score", 5).alias("score"), F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {DENSE}, f AS (SELECT ds.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS p FROM ds JOIN embeddings e ON e.vec_id = chunk_id WHERE e.label IN (1, 2))
SELECT query_id, chunk_id, round(score, 5) AS score FROM f WHERE p <= 5""")
def ret_dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2, FLT-4: the payload filter is in front of the search."""
    t = Tables(spark, sf_dir)
    q = t.benchmark.join(vectors_of(t), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "vec")
    top = dense.dense_search(q, vectors_of(t).filter(F.col("label").isin(1, 2)), 5)
    return top.select("query_id", F.col("vec_id").alias("chunk_id"), F.round("score", 5).alias("score"))


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round(rrf, 8) AS rrf, best_pos, rank_sources FROM fu")
def ret_rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-4, AG-6, JN-19, TK-3."""
    f = fused(Tables(spark, sf_dir))
    return f.select("query_id", "chunk_id", F.round("rrf", 8).alias("rrf"), F.col("best_pos").cast("long").alias("best_pos"), F.array_join("rank_sources", ",").alias("rank_sources"))


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round({BASE}, 5) AS base FROM fu")
def ret_base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-5, AG-7."""
    return fusion.base_scores(fused(Tables(spark, sf_dir))).select("query_id", "chunk_id", F.round("base", 5).alias("base"))


HYBRID = f"""
WITH {FUSED},
v AS (SELECT fu.*, d.text, e.ts FROM fu JOIN documents d ON d.doc_id = chunk_id LEFT JOIN events e ON e.event_id = chunk_id
      WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
b AS (SELECT *, {BASE} AS base, {RECENCY.format('ts')} AS temporal FROM v),
c AS (SELECT b.*, least(1.0, base + temporal) AS score,
             greatest(0, least(1, 0.7::DOUBLE * len(list_intersect(list_distinct({TOKENS.format('q.text')}), {TOKENS.format('b.text')})) / greatest(len(list_distinct({TOKENS.format('q.text')})), 1)
               + 0.3::DOUBLE * least(1, 200.0::DOUBLE / greatest(length(b.text), 1)))) AS rr
      FROM b JOIN benchmark q ON q.item_id = query_id),
s AS (SELECT query_id, chunk_id, rrf, least(1.0, 0.8::DOUBLE * score + 0.2::DOUBLE * rr) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(rrf, 12) DESC, chunk_id) AS pos FROM s)
"""


def hybrid(t: Tables, k: int, top: DataFrame | None = None) -> DataFrame:
    """The read path as one plan: both legs, fusion, visibility, scores, boosts, rerank, top k.

    What a candidate shares with its query is counted on the candidates' texts
    (40 a query at most), so postings are made once.

    Documents that ``labels`` marks as poor stand for archived ones; the event
    of the same number dates a document."""
    visible = visible_docs(t)
    f = fused(t, top).withColumn("memory_id", F.col("chunk_id")).withColumn("revision_id", F.col("chunk_id"))
    scored = fusion.base_scores(fusion.visible_only(f, visible))
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    asked = queries_of(t).select("query_id", T.lexemes(F.col("text")).alias("wanted"))
    dated = t.events.select(F.col("event_id").alias("chunk_id"), F.col("ts").alias("created"))
    none = F.lit(None).cast("double")
    full = batch.beside(scored, texts, "chunk_id").join(dated, "chunk_id", "left").withColumns({"graph_boost": none, "profile_boost": none, "importance": none, "occurred": F.lit(None).cast("timestamp_ntz"), "updated": F.lit(None).cast("timestamp_ntz")})
    combined = fusion.combine(full, stamp("2024-02-01")).join(asked, "query_id")
    shared = F.size(F.array_intersect(T.lexemes(F.col("text")), F.col("wanted")))
    rr = S.heuristic_rerank(shared, F.size("wanted"), F.length("text"))
    final = combined.withColumn("score", S.rerank_blend(F.col("score"), rr)).filter("score >= 0")
    return lexical.top_k(final, ["query_id"], [F.desc(F.round("score", 9)), F.desc(F.round("rrf", 12)), F.asc("chunk_id")], k)


@query(f"{HYBRID} SELECT query_id, pos, chunk_id, round(score, 5) AS score FROM r WHERE pos <= 5")
def ret_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-1 to RET-14, JN-19, TK-4: the flagship."""
    return hybrid(Tables(spark, sf_dir), 5).select("query_id", F.col("pos").cast("long").alias("pos"), "chunk_id", F.round("score", 5).alias("score"))


EXPECTED = """e AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
f AS (SELECT query_id, min(pos) AS rank FROM r JOIN e USING (query_id, chunk_id) WHERE pos <= 5 GROUP BY 1),
lk AS (SELECT query_id, count(*) AS leaks FROM r WHERE pos <= 5 AND chunk_id IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1),
l1 AS (SELECT query_id, min(chunk_id) AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS p FROM lx WHERE pos <= 20 AND chunk_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)) WHERE p = 1 GROUP BY 1),
cs AS (SELECT query_id, coalesce(rank <= 1, false) AS hit1, coalesce(rank <= 5, false) AS hit5, coalesce(1.0::DOUBLE / rank, 0) AS reciprocal_rank, coalesce(leaks, 0)::BIGINT AS leaks,
  (query_id, coalesce(l1.chunk_id, -1)) IN (SELECT (query_id, chunk_id) FROM e) AS lexical_hit1
  FROM (SELECT DISTINCT query_id FROM e) q LEFT JOIN f USING (query_id) LEFT JOIN lk USING (query_id) LEFT JOIN l1 USING (query_id))"""


def visible_docs(t: Tables) -> DataFrame:
    """(memory_id, revision_id) of documents that ``labels`` doesn't mark as poor."""
    poor = t.labels.filter("quality = 0").select(F.col("doc_id").alias("memory_id"))
    return t.documents.select(F.col("doc_id").alias("memory_id"), F.col("doc_id").alias("revision_id")).join(poor, "memory_id", "left_anti")


def expected(t: Tables) -> DataFrame:
    """Visible documents that hold a passage word for word: candidates share all its lexemes, so no pair is tried that can't."""
    near = batch.strict(queries_of(t), chunks_of(t))
    both = batch.beside(near, chunks_of(t), "chunk_id").join(queries_of(t).withColumnRenamed("text", "passage"), "query_id")
    held = both.filter(F.col("text").contains(F.col("passage"))).select("query_id", F.col("chunk_id").alias("source_file"))
    return held.join(visible_docs(t).select(F.col("memory_id").alias("source_file")), "source_file", "left_semi")


def cases(t: Tables) -> DataFrame:
    """A row for each benchmark item that a visible document holds, with what the lexical leg alone finds first."""
    pair = [F.col("chunk_id").alias(c) for c in ("source_file", "memory_id", "revision_id")]
    e, seen = scratch.stored(expected(t), "expected"), visible_docs(t)
    top = scratch.stored(lexical_top(t, 20), "lexical")
    scored = readiness.evaluate(hybrid(t, 5, top).select("query_id", "pos", *pair), e, seen)
    alone = top.select("query_id", "pos", *pair).join(seen, ["memory_id", "revision_id"], "left_semi")
    first = lexical.top_k(alone, ["query_id"], [F.asc("pos")], 1, "p").join(e, ["query_id", "source_file"], "left_semi").select("query_id", F.lit(True).alias("lexical_hit1"))
    return scored.join(first, "query_id", "left").fillna(False, ["lexical_hit1"])


@query(f"{HYBRID}, {EXPECTED} SELECT query_id, hit1, hit5, round(reciprocal_rank, 6) AS reciprocal_rank, leaks, lexical_hit1 FROM cs")
def ev_retrieval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-1, JN-29."""
    return cases(Tables(spark, sf_dir)).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query(f"""{HYBRID}, {EXPECTED} SELECT round(avg(hit1::INT::DOUBLE), 6) AS hit1, round(avg(hit5::INT::DOUBLE), 6) AS hit5, round(avg(reciprocal_rank), 6) AS mrr, sum(leaks)::BIGINT AS leaks, count(*) AS cases,
  avg(hit1::INT::DOUBLE) >= 0.8 AND avg(hit5::INT::DOUBLE) >= 0.9 AND sum(leaks) = 0 AS passed, round(avg(lexical_hit1::INT::DOUBLE), 6) AS lexical_hit1 FROM cs""")
def ev_retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-2, AG-10."""
    c = cases(Tables(spark, sf_dir))
    s = readiness.gate(readiness.summary(c, F.round(F.avg(F.col("lexical_hit1").cast("double")), 6).alias("lexical_hit1")))
    return s.select(F.round("hit1", 6).alias("hit1"), F.round("hit5", 6).alias("hit5"), F.round("mrr", 6).alias("mrr"), "leaks", "cases", "passed", "lexical_hit1")


@query(f"SELECT event_id, {RECENCY.format('ts')} AS boost FROM events")
def ret_recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-8, RET-9."""
    return Tables(spark, sf_dir).events.select("event_id", S.recency_boost(stamp("2024-02-01"), F.col("ts")).alias("boost"))


@query("""
SELECT c_custkey, round(CASE WHEN i = 1 THEN 0 ELSE least(0.10, 0.05::DOUBLE * (i - 1)) END, 6) AS boost, round(1 / (1 + exp(-x)), 6) AS sig,
       round(greatest(0, least(1, 0.6::DOUBLE / (1 + exp(-x)) + 0.4::DOUBLE * s)), 6) AS blended,
       round((1 + 0.25::DOUBLE) * (0.8 + 0.2::DOUBLE * greatest(0.5, least(2.0, i))), 4) AS old_importance,
       round(greatest(0, least(1, (s + least(c_nationkey * 0.05::DOUBLE, 0.3)) * pow(0.5, c_nationkey / 30.0::DOUBLE))), 6) AS aged
FROM (SELECT *, c_acctbal / 5000 AS i, c_acctbal / 2000 - 2 AS x, abs(c_acctbal) / 10000 AS s FROM customer)
""")
def ret_boost_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-8, RET-13, RET-23, SC-9, SC-10, SC-33."""
    b = F.col("c_acctbal")
    i, x, s, n = b / 5000, b / 2000 - 2, F.abs(b) / 10000, F.col("c_nationkey")
    return Tables(spark, sf_dir).customer.select(
        "c_custkey", F.round(S.importance_boost(i), 6).alias("boost"), F.round(S.sigmoid(x), 6).alias("sig"), F.round(S.model_blend(s, x), 6).alias("blended"),
        F.round(S.old_importance(F.lit(0.1), F.lit(0.1), F.lit(0.05), i), 4).alias("old_importance"), F.round(S.aged_importance(s, n, n), 6).alias("aged"),
    )


@query(f"""WITH {LEXICAL}, t5 AS (SELECT query_id, pos, 'doc' || chunk_id AS source_file, d.text FROM lx JOIN documents d ON d.doc_id = chunk_id WHERE pos <= 3)
SELECT query_id, sha256(string_agg('Source: ' || source_file || chr(10) || text, chr(10) || chr(10) ORDER BY pos)) AS context FROM t5 GROUP BY 1""")
def ret_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-19."""
    t = Tables(spark, sf_dir)
    r = batch.beside(lexical_top(t, 3), chunks_of(t), "chunk_id").select("query_id", "pos", F.concat(F.lit("doc"), F.col("chunk_id").cast("string")).alias("source_file"), "text")
    return C.context(r).select("query_id", F.sha2("context", 256).alias("context"))


@query(f"""WITH {LEXICAL} SELECT query_id, CAST(floor(sum(len(regexp_extract_all(d.text, '[^\\s]+'))) * 1.3::DOUBLE) AS BIGINT) AS tokens
FROM lx JOIN documents d ON d.doc_id = chunk_id WHERE pos <= 10 GROUP BY 1""")
def ret_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-22, SC-19."""
    t = Tables(spark, sf_dir)
    return C.token_total(batch.beside(lexical_top(t, 10), chunks_of(t), "chunk_id"))


@query()
def ret_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-16, RET-17, WN-6, SC-15, SC-20, SET-6: an ordered fold over at most ten results a query."""
    t = Tables(spark, sf_dir)
    r = batch.beside(lexical_top(t, 10), chunks_of(t), "chunk_id").select("query_id", F.col("pos").cast("int").alias("pos"), "chunk_id", "text", F.array(F.col("chunk_id").cast("string")).alias("evidence_ids"))
    return C.compress(r, budget=600).select("query_id", "pos", "chunk_id", F.length("text").alias("n_chars"), F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("""
WITH ed AS (SELECT 'n' || s_nationkey AS a, 'p' || (l_partkey % 100) AS b, CASE l_returnflag WHEN 'A' THEN 'fixes' WHEN 'N' THEN 'depends_on' ELSE 'mentions' END AS relation
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
w AS (SELECT a, b, CASE relation WHEN 'fixes' THEN 0.4 WHEN 'depends_on' THEN 0.15 ELSE 0.1 END::DOUBLE AS w FROM ed),
bo AS (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w),
r AS (SELECT n_nationkey AS query_id, p_partkey AS chunk_id, 'n' || n_nationkey AS qa, 'p' || (p_partkey % 100) AS rb FROM nation, part WHERE p_size = n_nationkey)
SELECT query_id, chunk_id, round(sum(w), 4) AS graph_boost FROM r JOIN bo ON a = qa AND b = rb GROUP BY 1, 2
""")
def ret_old_graph_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-22, JN-22."""
    t = Tables(spark, sf_dir)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    relation = F.when(F.col("l_returnflag") == "A", "fixes").when(F.col("l_returnflag") == "N", "depends_on").otherwise("mentions")
    ed = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(name("N", F.col("s_nationkey")).alias("src"), name("P", F.col("l_partkey") % 100).alias("dst"), relation.alias("relation"))
    q = t.nation.select(F.col("n_nationkey").alias("query_id"), F.array(name("n", F.col("n_nationkey"))).alias("entities"))
    r = t.nation.join(t.part, F.col("p_size") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("query_id"), F.col("p_partkey").alias("chunk_id"), F.array(name("p", F.col("p_partkey") % 100)).alias("entities"))
    return legacy.graph_boosts(q, r, ed).withColumn("graph_boost", F.round("graph_boost", 4))


@query("""
WITH x AS (SELECT n_nationkey AS query_id, unnest([n_nationkey, (n_nationkey + 1) % 25]) AS k, 0.02::DOUBLE * (n_nationkey % 7) AS weight FROM nation)
SELECT query_id, c_custkey AS chunk_id, round(least(0.10, max(weight)), 4) AS graph_boost FROM x JOIN customer ON c_nationkey = k GROUP BY 1, 2
""")
def ret_graph_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-6, JN-20."""
    t = Tables(spark, sf_dir)
    x = t.nation.select(F.col("n_nationkey").alias("query_id"), F.explode(F.array("n_nationkey", (F.col("n_nationkey") + 1) % 25)).alias("entity_key"), (0.02 * (F.col("n_nationkey") % 7)).alias("weight"))
    keys = x.select("query_id", "entity_key").distinct().join(t.customer.select(F.col("c_custkey").alias("chunk_id"), F.col("c_nationkey").alias("entity_key")), "entity_key")
    return fusion.graph_boosts(keys, x).withColumn("graph_boost", F.round("graph_boost", 4))


@query("""
WITH q AS (SELECT DISTINCT c_nationkey * 100 + length(c_mktsegment) AS query_id, 'about ' || lower(c_mktsegment) || ' in nation ' || c_nationkey AS q FROM customer)
SELECT DISTINCT query_id, c_custkey AS memory_id, 0.08::DOUBLE AS profile_boost FROM q JOIN customer ON contains(q, lower(c_mktsegment)) WHERE c_acctbal >= 0
""")
def ret_profile_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-7, JN-8, JN-21, FLT-8: profiles are market segments, customers in credit are evidence for theirs."""
    t = Tables(spark, sf_dir)
    k = F.lower("c_mktsegment")
    text = F.concat(F.lit("about "), k, F.lit(" in nation "), F.col("c_nationkey").cast("string"))
    q = t.customer.select((F.col("c_nationkey") * 100 + F.length("c_mktsegment")).cast("long").alias("query_id"), text.alias("query_key"), F.array().cast("array<string>").alias("entity_keys")).distinct()
    p = t.customer.select(k.alias("profile_id")).distinct().withColumn("canonical_key", F.col("profile_id"))
    f = t.customer.select(k.alias("profile_id"), F.when(F.col("c_acctbal") >= 0, "active").otherwise("superseded").alias("status"), F.col("c_custkey").alias("evidence_memory_id"), F.col("c_custkey").alias("evidence_revision_id"))
    d = t.customer.select(F.col("c_custkey").alias("memory_id"), F.lit("active").alias("doc_status"), F.col("c_custkey").alias("current_revision_id"))
    return profiles.profile_boosts(q, p, f, d)


@query("""
WITH raw AS (SELECT item_id AS id, text, 'new' AS side FROM benchmark UNION ALL SELECT doc_id, text, 'old' FROM documents),
n AS (SELECT id, side, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body,
             coalesce(left(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '---'))[1], 80), 'Memory') AS title FROM raw),
s AS (SELECT *, CASE WHEN sl = '' THEN 'memory' ELSE sl END AS slug FROM (SELECT *, left(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 72) AS sl FROM n)),
m AS (SELECT a.id, min({'path': printf('Concepts/%06d.md', b.id), 'held': contains(b.body, a.body)}) AS m FROM s a JOIN s b ON a.side = 'new' AND b.side = 'old' AND (a.slug = b.slug OR lower(trim(a.title)) = lower(trim(b.title))) GROUP BY 1)
SELECT a.id, CASE WHEN m IS NULL THEN 'ADD' WHEN m.held THEN 'NOOP' ELSE 'UPDATE' END AS decision, m.path AS match_path FROM s a LEFT JOIN m USING (id) WHERE a.side = 'new'
""")
def ret_write_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-18, SNK-17, JN-30, PRJ-17."""
    t = Tables(spark, sf_dir)
    new = t.benchmark.select(F.col("item_id").alias("id"), F.lit("semantic").alias("category"), "text", F.lit(False).alias("dedup"))
    old = t.documents.select(F.format_string("Concepts/%06d.md", "doc_id").alias("path"), "text")
    return writing.write_decisions(new, old)


@query("""
WITH terms AS (SELECT item_id AS task_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from'))) AS ts FROM benchmark),
notes AS (SELECT 'Tasks/c' || conv_id || '_' || turn || '.md' AS path, text, text || ' c' || conv_id || '_' || turn AS f FROM conversations),
sc AS (SELECT task_id, path, CAST(list_sum(list_transform(ts, lambda x: (length(lower(f)) - length(replace(lower(f), x, ''))) // length(x))) AS BIGINT) AS score FROM terms, notes),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path) AS pos FROM sc WHERE score > 0)
SELECT task_id, pos, path FROM r WHERE pos <= 4
""")
def ret_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-20, TK-9, SC-26, SC-27."""
    t = Tables(spark, sf_dir)
    tasks = t.benchmark.select(F.col("item_id").alias("task_id"), "text")
    notes = t.conversations.select(F.format_string("Tasks/c%d_%d.md", "conv_id", "turn").alias("path"), "text")
    return writing.procedures(tasks, notes).select("task_id", F.col("pos").cast("long").alias("pos"), "path")


@query("""
WITH q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(t, 'how to') OR contains(t, 'step') OR contains(t, 'code') OR contains(t, 'fix') OR contains(t, 'debug') THEN 'procedural_memory' WHEN contains(t, 'summarize') THEN 'summaries' ELSE 'semantic_memory' END AS collection FROM q
""")
def ret_old_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-21, SC-21."""
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", legacy.collection_of(F.col("text")).alias("collection"))


@query(f"""
WITH {DENSE}, g AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, score FROM dn WHERE pos <= 10 UNION ALL SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, score AS rank, pos FROM dn WHERE pos <= 3)) GROUP BY ALL),
x AS (SELECT g.*, (1 + {RECENCY.format('ts')}) * (0.8 + 0.2::DOUBLE) AS importance, round(greatest(0, least(1, 0.6::DOUBLE * 0.5 + 0.4::DOUBLE * score)), 9) AS s FROM g JOIN events ON event_id = chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(importance, 9) DESC, s DESC, chunk_id) AS pos FROM x)
SELECT query_id, chunk_id, pos FROM r WHERE pos <= 5
""")
def ret_old_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-21, RET-23, TK-6."""
    t = Tables(spark, sf_dir)
    top = dense_top(t, 10).select("query_id", F.col("vec_id").alias("chunk_id"), "score", "pos")
    g = legacy.gather(top.select("query_id", "chunk_id", "score"), top.filter("pos <= 3").select("query_id", "chunk_id", "score"))
    dated = g.join(t.events.select(F.col("event_id").alias("chunk_id"), F.col("ts").alias("created")), "chunk_id")
    none = F.lit(None).cast("double")
    full = dated.withColumns({"graph_boost": none, "identity_boost": none, "importance": none})
    imp = legacy.ranked(full, F.lit(0.5), stamp("2024-02-01"), 10)
    again = lexical.top_k(imp.drop("pos"), ["query_id"], [F.desc(F.round("importance", 9)), F.desc(F.round("score", 9)), F.asc("chunk_id")], 5)
    return again.select("query_id", "chunk_id", F.col("pos").cast("long").alias("pos"))


@query("""
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def ret_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-11."""
    t = Tables(spark, sf_dir)
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return a.join(b, "a").select("a", "b", F.round(cosine(F.col("ea"), F.col("eb")), 5).alias("cos"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' OR source = (SELECT min(source) FROM documents)")
def ret_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3: chunks that bear one of the tags asked for."""
    d = Tables(spark, sf_dir).documents
    tags = F.filter(F.array("lang", "source"), lambda x: x.isNotNull())
    least = d.agg(F.min("source")).first()[0]
    return lexical.filtered(d.select("doc_id", tags.alias("tags")), tags=["de", least]).select("doc_id")


@query("""WITH c AS (SELECT l_orderkey % 50 AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS memory_id, CASE WHEN l_linenumber <> 6 THEN l_orderkey * 2 END AS revision_id,
  least(1.0, 0.8::DOUBLE * (l_quantity / 50.0::DOUBLE) + 0.2::DOUBLE * l_discount) AS score, l_extendedprice::DOUBLE AS rrf FROM lineitem),
v AS (SELECT * FROM c JOIN orders ON o_orderkey = memory_id AND o_orderkey * 2 = revision_id WHERE o_orderstatus <> 'F' AND score >= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, chunk_id) AS pos FROM v)
SELECT query_id, chunk_id, pos FROM r WHERE pos <= 4""")
def ret_valid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6, FLT-7, FLT-9, RET-11, RET-14: candidates without ids or of hidden revisions go, then threshold and limit."""
    t = Tables(spark, sf_dir)
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    c = t.lineitem.select(
        (key % 50).alias("query_id"), (key * 10 + n).alias("chunk_id"), F.when(n != 7, key).alias("memory_id"), F.when(n != 6, key * 2).alias("revision_id"),
        (F.col("l_quantity") / 50.0).alias("score"), F.col("l_extendedprice").cast("double").alias("rrf"), F.col("l_discount").cast("double").alias("rerank"),
    )
    seen = t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("memory_id"), (F.col("o_orderkey") * 2).alias("revision_id"))
    top = fusion.rerank(fusion.visible_only(c, seen), F.col("rerank"), 4, 0.3)
    return top.select("query_id", "chunk_id", F.col("final_pos").cast("long").alias("pos"))


@query("SELECT count(*) AS queries, 10 AS k, true AS recall_reached, true AS all_found_exact FROM embeddings WHERE vec_id % 50 = 0")
def ret_dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-2: a stored index of all embeddings, asked by every fiftieth row: recall at 10 is 0.9 or more, and scores are exact cosines."""
    e = vectors_of(Tables(spark, sf_dir)).select("vec_id", "vec")
    index = vector_index.build(e, f"{scratch.root(spark)}/lorekeep/vectors-{uuid.uuid4().hex}", k=10)
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    got = vector_index.search(q, index).select("query_id", "vec_id", F.col("score").alias("found"))
    both = dense.dense_search(q, e, 10).join(got, ["query_id", "vec_id"], "left")
    recall = F.count("found") / F.count(F.lit(1))
    return both.agg(F.countDistinct("query_id").alias("queries"), F.lit(10).alias("k"), (recall >= 0.9).alias("recall_reached"), F.bool_and(F.coalesce(F.col("found") == F.col("score"), F.lit(True))).alias("all_found_exact"))


TOKEN_ROWS = """SELECT {0} AS chunk_id, generate_subscripts(ws, 1) - 1 AS place, unnest(ws) AS lexeme FROM (SELECT *, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM {1})"""
#: Minimal covers by window functions: the last place of each shared lexeme at each place; a cover ends where the least of them has moved.
COVERS = """
t AS (SELECT DISTINCT query_id, lexeme FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS lexeme FROM q)),
h AS (SELECT t.query_id, p.chunk_id, p.lexeme, p.place, row_number() OVER (PARTITION BY t.query_id, p.chunk_id ORDER BY p.place) AS rn FROM t JOIN p USING (lexeme)),
st AS (SELECT DISTINCT query_id, chunk_id, lexeme AS term FROM h),
x AS (SELECT query_id, chunk_id, place, rn, max(CASE WHEN lexeme = term THEN place END) OVER w AS last, max(CASE WHEN lexeme = term THEN rn END) OVER w AS last_rn
      FROM h JOIN st USING (query_id, chunk_id) WINDOW w AS (PARTITION BY query_id, chunk_id, term ORDER BY place)),
e AS (SELECT query_id, chunk_id, place, rn, min(last) AS first, min(last_rn) AS first_rn FROM x GROUP BY ALL HAVING count(last) = count(*)),
c AS (SELECT query_id, chunk_id, first, min(place) AS stop, min(rn) - min(first_rn) + 1 AS own FROM e GROUP BY ALL),
d AS (SELECT query_id, chunk_id, count(*) AS covers, sum(0.1::DOUBLE / (1 + (stop - first + 1 - own)) ORDER BY stop) AS density FROM c GROUP BY ALL)
SELECT query_id, chunk_id, covers, round(least(0.25::DOUBLE, density), 9) AS density FROM d
"""
SENTENCES = "SELECT item_id * 1000 + i AS query_id, s AS text FROM (SELECT item_id, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM (SELECT item_id, string_split_regex(text, '[.!?]+') AS ss FROM benchmark))"


def sentences_of(t: Tables) -> DataFrame:
    """(query_id, text): the parts of benchmark items between . ! and ?"""
    return t.benchmark.select("item_id", F.posexplode(F.split("text", "[.!?]+")).alias("i", "text")).select((F.col("item_id") * 1000 + F.col("i")).alias("query_id"), "text")


def _densities(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    found = batch.cover_densities(queries, chunks)
    return found.select("query_id", "chunk_id", F.col("covers").cast("long").alias("covers"), F.round(F.least(F.lit(lexical.DENSITY_CAP), F.col("density")), 9).alias("density"))


@query(f"WITH q AS (SELECT item_id AS query_id, string_split_regex(text, '[.!?]+')[1] AS text FROM benchmark), p AS ({TOKEN_ROWS.format('doc_id', 'documents')}), {COVERS}")
def ret_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-6: cover density of the benchmark items' first sentences in whole documents."""
    t = Tables(spark, sf_dir)
    return _densities(t.benchmark.select(F.col("item_id").alias("query_id"), F.get(F.split("text", "[.!?]+"), F.lit(0)).alias("text")), chunks_of(t))


@query(f"WITH q AS ({SENTENCES}), p AS ({TOKEN_ROWS.format('conv_id * 1000 + turn', 'conversations')}), {COVERS}")
def ret_turn_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-6: cover density of all the benchmark items' sentences in turns of conversations."""
    t = Tables(spark, sf_dir)
    turns = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "text")
    return _densities(sentences_of(t), turns)


RUNS = """k AS (SELECT doc_id AS chunk_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') || ' ' AS run FROM documents),
q AS (SELECT query_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM (""" + SENTENCES + "))"


def _web(t: Tables, text) -> DataFrame:
    """Matches of queries that are made of a sentence's lexemes ``ws``, in documents."""
    q = sentences_of(t).select("query_id", T.tokens(F.col("text")).alias("ws")).filter("size(ws) >= 3").select("query_id", text.alias("text"))
    return batch.web_matches(q, chunks_of(t))


@query(f"WITH {RUNS} SELECT query_id, chunk_id FROM q, k WHERE len(ws) >= 3 AND contains(run, ' ' || array_to_string(ws, ' ') || ' ')")
def ret_web_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-5: whole sentences as quoted phrases."""
    return _web(Tables(spark, sf_dir), F.concat(F.lit('"'), F.array_join("ws", " "), F.lit('"')))


@query(f"WITH {RUNS} SELECT query_id, chunk_id FROM q, k WHERE len(ws) >= 3 AND contains(run, ' ' || ws[1] || ' ' || ws[2] || ' ') AND NOT contains(run, ' ' || ws[3] || ' ')")
def ret_web_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-5: a phrase of two words, without a third word."""
    return _web(Tables(spark, sf_dir), F.expr("concat('\"', ws[0], ' ', ws[1], '\" -', ws[2])"))


@query(f"""WITH {RUNS} SELECT query_id, chunk_id FROM q, k WHERE len(ws) >= 3 AND (contains(run, ' ' || ws[1] || ' ' || ws[2] || ' ' || ws[3] || ' ')
  OR (contains(run, ' ' || ws[-1] || ' ') AND contains(run, ' ' || ws[1] || ' ') AND NOT contains(run, ' ' || ws[2] || ' ' || ws[3] || ' ')))""")
def ret_web_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-5: a phrase, or two words without a phrase."""
    return _web(Tables(spark, sf_dir), F.expr("""concat('"', ws[0], ' ', ws[1], ' ', ws[2], '" or "', ws[size(ws) - 1], '" "', ws[0], '" -"', ws[1], ' ', ws[2], '"')"""))
