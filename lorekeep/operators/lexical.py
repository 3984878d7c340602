"""RET-1: lexical retrieval for a batch of queries over an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: A query that holds all lexemes of a query gets this, cover density at most as much.
STRICT, DENSITY_CAP, DENSITY = 0.25, 0.25, 0.1


def index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", analyzer=T.tokens, queries: DataFrame | None = None) -> DataFrame:
    """Postings (chunk, lexeme, tf): a partial aggregate before the shuffle.

    With ``queries`` (a batch that the index is made for), only tokens that
    the batch asks for are kept, before anything moves; without, all are, for
    a table to be stored and kept."""
    each = chunks.select(F.col(id_col).alias("chunk_id"), F.explode(analyzer(F.col(text_col))).alias("lexeme"))
    if queries is not None:
        asked = queries.select(F.explode(T.lexemes(F.col("text"))).alias("lexeme")).distinct()
        each = each.join(asked, "lexeme", "left_semi")
    return each.groupBy("chunk_id", "lexeme").agg(F.count(F.lit(1)).alias("tf"))


def lexical_matches(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, chunk_id, coverage, strict, rank, shared, n) of chunks that share a lexeme with a query:
    ``shared`` of its ``n`` lexemes.

    An equi-join on the lexeme: only chunks with a shared lexeme are touched,
    never all pairs.  ``queries`` has query_id and text.
    """
    q = queries.select("query_id", T.lexemes(F.col("text")).alias("lexemes"))
    terms = q.select("query_id", F.size("lexemes").alias("n"), F.explode("lexemes").alias("lexeme"))
    hits = terms.join(postings, "lexeme").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("shared"), F.sum("tf").alias("positions"), F.max("n").alias("n"))
    return scored(hits)


def scored(hits: DataFrame) -> DataFrame:
    """Coverage, strict match and rank of hits (query_id, chunk_id, shared, positions, n)."""
    coverage = F.col("shared") / F.greatest(F.col("n"), F.lit(1))
    strict = F.col("shared") == F.col("n")
    rank = coverage + F.when(strict, STRICT).otherwise(0.0) + F.least(F.lit(DENSITY_CAP), DENSITY * F.col("positions"))
    return hits.select("query_id", "chunk_id", coverage.alias("coverage"), strict.alias("strict"), rank.alias("rank"), "shared", "n")


def lexical_order() -> list[Column]:
    """TK-1: coverage, strict match, rank; the chunk id breaks ties."""
    return [F.desc("coverage"), F.desc("strict"), F.desc("rank"), F.asc("chunk_id")]


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "pos") -> DataFrame:
    """WN-1, WN-9: the first k rows a key; Spark limits each map task to k a key before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def lexical_search(queries: DataFrame, postings: DataFrame, k: int = 20) -> DataFrame:
    return top_k(lexical_matches(queries, postings), ["query_id"], lexical_order(), k)


def filtered(chunks: DataFrame, memory_types: list[str] = (), projects: list[str] = (), agents: list[str] = (), tags: list[str] = ()) -> DataFrame:
    """FLT-2, FLT-3: optional filters; pushed to the scan."""
    for col, values in (("memory_type", memory_types), ("project", projects), ("source_agent", agents)):
        if values:
            chunks = chunks.filter(F.col(col).isin(list(values)))
    return chunks.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else chunks
