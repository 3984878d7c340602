"""RET-16, RET-17, RET-19: near-duplicate merge and token-budget packing of a query's results.

A query's results (at most k) are one array; merging and packing are folds over
it.  Only the similarity of two texts is computed outside of the plan's
expressions, by one Arrow UDF over the arrays.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import ratio, surely_different

#: A text is shortened only if so many tokens are left.
LEAST = 40


def similar_udf(threshold: float):
    """texts -> for each the numbers of the earlier ones that are alike beyond the threshold."""

    def alike(a: str, b: str) -> bool:
        return not surely_different(a, b, threshold) and ratio(a, b) > threshold

    @F.pandas_udf("array<array<int>>")
    def earlier(s: pd.Series) -> pd.Series:
        return pd.Series([[[j for j in range(i) if alike(t, texts[j])] for i, t in enumerate(texts)] for texts in s], dtype=object)

    return earlier


def owners(earlier: Column) -> Column:
    """For each number the first kept one that it is like, or itself, which keeps it."""

    def step(made: Column, near: Column) -> Column:
        kept = F.filter(near, lambda j: F.get(made, j) == j)
        return F.concat(made, F.array(F.coalesce(F.get(kept, F.lit(0)), F.size(made))))

    return F.aggregate(earlier, F.array().cast("array<int>"), step)


def packed(rows: Column, budget: int, kind: str) -> Column:
    """The rows (structs with a text) that fit the budget, in order; one that
    doesn't is shortened if LEAST tokens are left, and then kept if it fits."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        left = F.lit(budget) - acc["used"]
        whole = T.token_estimate(r["text"])
        text = F.when((whole <= left) | (left < LEAST), r["text"]).otherwise(T.extractive(r["text"], left))
        size = T.token_estimate(text)
        taken = F.struct((acc["used"] + size).alias("used"), F.concat(acc["out"], F.array(r.withField("text", text))).alias("out"))
        return F.when(size <= left, taken).otherwise(acc)

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def compress(results: DataFrame, budget: int = 2000, threshold: float = 0.85, lists: list[str] | None = None) -> DataFrame:
    """results: query_id, pos, text and any further columns; array columns named
    in ``lists`` are merged.  Keeps the order, renumbers ``pos``.  Null texts are empty."""
    names = [c for c in ("entities", "evidence_ids", "rank_sources") if c in results.columns] if lists is None else lists
    empty = {c: F.coalesce(F.col(c), F.array().cast(results.schema[c].dataType)) for c in names}
    clean = results.withColumns({"text": F.coalesce("text", F.lit("")), **empty})
    fields = ["pos", *[c for c in clean.columns if c not in ("query_id", "pos")]]
    kind = clean.select(F.struct(*fields).alias("r")).schema["r"].dataType.simpleString()
    one = clean.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    one = one.withColumn("owner", owners(similar_udf(threshold)(F.transform("rows", lambda r: r["text"]))))
    at = F.sequence(F.lit(0), F.size("rows") - 1)

    def merged(i: Column) -> Column:
        row = F.get("rows", i)
        for c in names:
            of = F.filter(F.transform("rows", lambda r, j: F.when(F.get("owner", j) == i, r[c])), lambda x: x.isNotNull())  # noqa: B023
            row = row.withField(c, F.array_distinct(F.flatten(of)))
        return row

    one = one.withColumn("rows", F.transform(F.filter(at, lambda i: F.get("owner", i) == i), merged))
    out = one.select("query_id", F.posexplode(packed(F.col("rows"), budget, kind)).alias("at", "r"))
    value = {"query_id": F.col("query_id"), "pos": (F.col("at") + 1).cast(results.schema["pos"].dataType)}
    return out.select(*[value.get(c, F.col(f"r.{c}")).alias(c) for c in results.columns])


def context(results: DataFrame) -> DataFrame:
    """RET-19: one text a query: its results' sources and texts in order."""
    block = F.concat(F.lit("Source: "), F.coalesce("source_file", F.lit("")), F.lit("\n"), "text")
    ordered = F.sort_array(F.collect_list(F.struct("pos", block.alias("b"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"))


def token_total(results: DataFrame) -> DataFrame:
    """AG-22."""
    return results.groupBy("query_id").agg(F.floor(F.sum(F.size(T.split_words(F.col("text")))) * 1.3).cast("long").alias("tokens"))
