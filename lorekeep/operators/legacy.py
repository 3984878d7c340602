"""RET-21 to RET-24, JN-22, TK-6: the older retrieval path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import vocab
from .lexical import top_k

COLLECTION = {"procedural": "procedural_memory", "summary": "summaries", "semantic": "semantic_memory"}


def collection_of(query: Column) -> Column:
    return T.lookup(COLLECTION, T.intent(query), "semantic_memory")


def gather(base: DataFrame, expanded: DataFrame) -> DataFrame:
    """RET-21: hits of the query and of its expanded entities, the best score a (query, chunk)."""
    return base.unionByName(expanded).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def graph_boosts(queries: DataFrame, results: DataFrame, edges: DataFrame) -> DataFrame:
    """RET-22, JN-22: sum of edge weights between a query's and a result's entities, both directions, without case.

    queries: query_id, entities; results: query_id, chunk_id, entities.  Equi-joins on lower-case names."""
    weight = T.lookup(vocab.OLD_GRAPH_WEIGHTS, F.lower("relation"), vocab.OLD_GRAPH_DEFAULT)
    e = edges.select(F.lower("src").alias("a"), F.lower("dst").alias("b"), weight.alias("w"))
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    q = queries.select("query_id", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("a"))
    r = results.select("query_id", "chunk_id", F.explode(F.array_distinct(F.transform("entities", F.lower))).alias("b"))
    return q.join(both, "a").join(r, ["query_id", "b"]).groupBy("query_id", "chunk_id").agg(F.sum("w").alias("graph_boost"))


def ranked(results: DataFrame, rerank: Column, as_of: Column, k: int) -> DataFrame:
    """RET-23, TK-6: importance with all boosts, blended score, order by importance and score."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    imp = S.old_importance(zero("graph_boost"), zero("identity_boost"), S.recency_boost(as_of, F.col("created")), F.coalesce("importance", F.lit(1.0)))
    out = results.withColumn("importance", imp).withColumn("score", S.clamp(0.6 * rerank + 0.4 * F.col("score")))
    return top_k(out, ["query_id"], [F.desc("importance"), F.desc("score"), F.asc("chunk_id")], k)
