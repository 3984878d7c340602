"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """SC-11: 0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n))


def weighted_mean(vectors: Column, weights: Column, dim: int) -> Column:
    """SC-12: the mean of vectors by weight, as a unit vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(F.arrays_zip(vectors.alias("v"), weights.alias("w")), zero, lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + b * x["w"]))
    return normalised(total)


def routed(vector: Column, dim: int) -> Column:
    """SNK-16: a missing vector is zeros."""
    return F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dim))
