"""Scores and boosts as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clamp


def age_days(as_of: Column, at: Column) -> Column:
    """Days from at to as_of, not negative (microsecond precision); null without a time."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0)))


def recency_boost(as_of: Column, at: Column, most: float = 0.15, half_life: float = 14.0) -> Column:
    """SC-8: most x 2^(-age / half-life), four decimals; 0 without a time."""
    return F.coalesce(F.round(F.lit(most) * F.pow(F.lit(2.0), -age_days(as_of, at) / half_life), 4), F.lit(0.0))


def aged_importance(base: Column, n_links: Column, days: Column) -> Column:
    """SC-9: (base + 0.05 a link, 0.3 at most), halved every 30 days, in 0..1."""
    return clamp((base + F.least(n_links * 0.05, F.lit(0.3))) * F.pow(F.lit(0.5), days / 30.0))


def sigmoid(x: Column) -> Column:
    """SC-10; exp never sees a positive argument."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def base_score(rrf: Column, top_rrf: Column, semantic: Column, lexical: Column, n_lists: Column) -> Column:
    """RET-5.  semantic and lexical are a candidate's raw scores, null if it isn't in that list."""
    raw = F.greatest(F.coalesce(clamp(semantic), F.lit(0.0)), F.when(lexical.isNotNull(), F.lit(0.5)).otherwise(0.0), F.coalesce(clamp(lexical), F.lit(0.0)))
    return 0.40 * rrf / top_rrf + 0.40 * raw + 0.20 * (n_lists / 2.0)


def importance_boost(importance: Column) -> Column:
    """RET-8."""
    return F.when(importance == 1.0, 0.0).otherwise(F.least(F.lit(0.10), 0.05 * (importance - 1.0)))


def heuristic_rerank(shared: Column, n_query: Column, n_chars: Column) -> Column:
    """RET-12."""
    return clamp(0.7 * shared / F.greatest(n_query, F.lit(1)) + 0.3 * F.least(F.lit(1.0), 200.0 / F.greatest(n_chars, F.lit(1))))


def rerank_blend(score: Column, rerank: Column) -> Column:
    """RET-11."""
    return F.least(F.lit(1.0), 0.8 * score + 0.2 * clamp(rerank))


def model_blend(score: Column, logit: Column) -> Column:
    """RET-13: the older blend with a model's logit."""
    return clamp(0.6 * sigmoid(logit) + 0.4 * score)


def old_importance(graph: Column, identity: Column, temporal: Column, importance: Column) -> Column:
    """RET-23."""
    return (1 + graph + identity + temporal) * (0.8 + 0.2 * F.greatest(F.lit(0.5), F.least(F.lit(2.0), importance)))


def profile_score(profile: Column, score: Column, importance: Column, has_code: Column, n_entities: Column, episodic: Column) -> Column:
    """The compressor's profile scorer (not applied by default)."""
    common = score * 0.5 + importance * 0.2
    return (
        F.when(profile == "coding", common + F.when(has_code, 0.3).otherwise(0.0))
        .when(profile == "research", common + F.least(n_entities / 5.0, F.lit(1.0)) * 0.3)
        .when(profile == "conversational", common + F.when(episodic, 0.3).otherwise(0.0))
        .otherwise(score)
    )
