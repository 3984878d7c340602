"""RET-4 to RET-14, JN-19 to JN-21: fusion of ranked lists, bounded boosts, rerank, final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .lexical import top_k

RRF = 60
BOOST_CAP, PROFILE_BOOST = 0.10, 0.08


def fuse(lists: DataFrame, k: int = RRF) -> DataFrame:
    """RET-4, AG-6: lists has (query_id, source, chunk_id, pos, score); one row a
    (query, chunk).  A union and one aggregate stand for the full outer join."""
    return lists.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("pos"))).alias("rrf"),
        F.max(F.when(F.col("source") == "semantic", F.col("score"))).alias("semantic"),
        F.max(F.when(F.col("source") == "lexical", F.col("score"))).alias("lexical"),
        F.min("pos").alias("best_pos"),
        F.sort_array(F.collect_set("source")).alias("rank_sources"),
    )


def visible_only(fused: DataFrame, visible: DataFrame) -> DataFrame:
    """RET-14, FLT-6, FLT-9: only (memory, revision) pairs that are visible; after
    fusion, so that hidden items have taken their ranks."""
    return fused.dropna(subset=["memory_id", "revision_id"]).join(visible.select("memory_id", "revision_id").distinct(), ["memory_id", "revision_id"], "left_semi")


def base_scores(fused: DataFrame) -> DataFrame:
    """RET-5, AG-7: base score; the fused rank is scaled by its query's largest."""
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    scaled = fused.withColumn("top_rrf", F.when(top > 0, top).otherwise(1.0))
    return scaled.withColumn("base", S.base_score(F.col("rrf"), F.col("top_rrf"), F.col("semantic"), F.col("lexical"), F.size("rank_sources"))).drop("top_rrf")


def graph_boosts(keys: DataFrame, expansion: DataFrame) -> DataFrame:
    """RET-6, JN-20: (query_id, chunk_id, graph_boost) from (query_id, chunk_id, entity_key) and (query_id, entity_key, weight)."""
    return keys.join(expansion, ["query_id", "entity_key"]).groupBy("query_id", "chunk_id").agg(F.least(F.lit(BOOST_CAP), F.max("weight")).alias("graph_boost"))


def combine(scored: DataFrame, as_of: Column) -> DataFrame:
    """RET-8 to RET-10.  Needs base, graph_boost, profile_boost, importance and
    the times occurred, updated, created; nulls are no boost."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    imp = F.coalesce(F.col("importance"), F.lit(1.0))
    graph, profile = F.least(F.lit(BOOST_CAP), zero("graph_boost")), F.least(F.lit(BOOST_CAP), zero("profile_boost"))
    temporal = S.recency_boost(as_of, F.coalesce("occurred", "updated", "created"))
    return scored.withColumn("score", F.least(F.lit(1.0), F.col("base") + graph + profile + S.importance_boost(imp) + temporal)).withColumn("importance_out", F.round(F.least(F.lit(1.25), imp + graph + profile + temporal), 4))


def rerank(scored: DataFrame, rerank_score: Column, k: int, min_score: float = 0.0) -> DataFrame:
    """RET-11, TK-4, FLT-7: blend, threshold, order by score and fused rank, limit."""
    final = scored.withColumn("score", S.rerank_blend(F.col("score"), rerank_score)).filter(F.col("score") >= min_score)
    return top_k(final, ["query_id"], [F.desc("score"), F.desc("rrf"), F.asc("chunk_id")], max(k, 0), "final_pos")


def heuristic(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """RET-12: adds ``rerank`` to candidates (query_id, chunk_id, n_chars): what they
    share with the query is known from the lexical matches, so no text is read again."""
    known = matches.select("query_id", "chunk_id", "shared", "n")
    both = candidates.join(known, ["query_id", "chunk_id"], "left")
    rr = S.heuristic_rerank(F.coalesce("shared", F.lit(0)), F.coalesce("n", F.lit(1)), F.col("n_chars"))
    return both.withColumn("rerank", rr).drop("shared", "n")


def over_fetch(limit: int) -> int:
    """TK-3."""
    return max(4 * limit, 20)
