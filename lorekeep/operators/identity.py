"""ID-1 to ID-14: trait evidence, stability, contradictions, weights, versions, injection, incremental update.

Traits, evidence and versions are DataFrames keyed by entity; an order-dependent
fold is an ``aggregate`` over an entity's sorted evidence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

FLOOR, DORMANT, PENALTY = 0.2, 0.15, 0.15


def evidence(memories: DataFrame, domains: Mapping[str, Sequence[str]] = vocab.DOMAIN_WORDS, traits: Mapping[str, Sequence[str]] = vocab.TRAIT_WORDS) -> DataFrame:
    """ID-1: (entity_id, memory_id, trait_id, domain_id, strength, matched, detected_at) of memories (entity_id, memory_id, text, detected_at;
    summary, tags and event_type are searched too where there are such columns).

    The word lists are literals of the plan: one pass over the memories, no join."""
    there = {c: F.col(c) for c in ("summary", "text", "event_type") if c in memories.columns}
    tags = F.array_join("tags", " ") if "tags" in memories.columns else F.lit(None).cast("string")
    parts = [there.get("summary"), there["text"], tags, there.get("event_type")]
    low = F.lower(F.concat_ws(" ", *[c for c in parts if c is not None]))

    def found(name: str, words: Sequence[str], domain: str | None, factor: float) -> Column:
        n = T.contains_count(low, words)
        strength = F.least(F.lit(1.0), n / float(len(words)) * factor)
        key = F.lit(f"domain_{domain}" if domain else name)
        return F.struct(key.alias("trait_id"), F.lit(domain or "core_traits").alias("domain_id"), strength.alias("strength"), n.alias("matched"))

    all_ = [found(d, w, d, 2.0) for d, w in domains.items()] + [found(t, w, None, 2.5) for t, w in traits.items()]
    each = memories.select("entity_id", "memory_id", "detected_at", F.explode(F.filter(F.array(*all_), lambda x: x["matched"] > 0)).alias("e"))
    return each.select("entity_id", "memory_id", "detected_at", "e.*")


def category(trait: Column) -> Column:
    """ID-2."""
    return (
        F.when(T.contains_count(trait, vocab.CORE_TRAITS) > 0, "core")
        .when(T.contains_count(trait, ["long_term", "drive", "motivation"]) > 0, "persistent")
        .when(T.contains_count(trait, ["stress", "pressure"]) > 0, "adaptive")
        .when(trait.contains("trigger"), "temporary")
        .otherwise("adaptive")
    )


def stability(count: Column, span_days: Column, kind: Column) -> Column:
    """ID-5, AG-18."""
    rate = F.when(span_days > 0, count / F.greatest(span_days / 30.0, F.lit(1.0))).otherwise(count.cast("double"))
    raw = (F.least(F.lit(1.0), count / 5.0) * 0.5 + F.least(F.lit(1.0), span_days / 90.0) * 0.3 + rate * 0.2) * T.lookup(vocab.CATEGORY_MODIFIER, kind, 0.5)
    return F.when(count < 2, 0.0).otherwise(F.round(F.least(F.lit(1.0), raw), 4))


def stability_by_factors(count: Column, span_days: Column, rate: Column, contradictions: Column) -> Column:
    """ID-5, the model's own formula."""
    raw = F.least(count / 10.0, F.lit(1.0)) * 0.4 + F.least(span_days / 90.0, F.lit(1.0)) * 0.4 + rate * 0.2 - F.least(contradictions * 0.2, F.lit(0.6))
    return F.round(T.clamp(raw), 4)


def tier(raw: Column) -> Column:
    return F.when(raw >= 0.8, "core").when(raw >= 0.5, "medium").when(raw >= 0.25, "low").otherwise("unstable")


def fold(start: Column, strengths: Column, decimals: int | None = 4) -> Column:
    """ID-3, WN-5: for each evidence in order 0.7 c + 0.3 x mean so far, to four decimals at each step (or without rounding)."""
    zero = F.struct(start.cast("double").alias("c"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        total, n = acc["sum"] + s, acc["n"] + 1
        c = acc["c"] * 0.7 + total / n * 0.3
        return F.struct(T.clamp(c if decimals is None else F.round(c, decimals)).alias("c"), total.alias("sum"), n.alias("n"))

    return F.aggregate(strengths, zero, step, lambda acc: acc["c"])


def strengths(found: DataFrame) -> DataFrame:
    """(entity_id, trait_id, strengths): each trait's evidence in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("detected_at", "memory_id", "strength"))), lambda e: e["strength"])
    return found.groupBy("entity_id", "trait_id").agg(ordered.alias("strengths"))


def traits(found: DataFrame, least: int = 2) -> DataFrame:
    """ID-2, AG-17: traits with at least two evidences: mean strength, folded confidence, stability."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("detected_at", "memory_id", "strength"))), lambda e: e["strength"])
    span = (F.unix_micros(F.max("detected_at").cast("timestamp")) - F.unix_micros(F.min("detected_at").cast("timestamp"))) / 86_400_000_000.0
    # added up in order of evidence: a sum in the order of a shuffle may round to another fourth decimal in each run
    mean = F.aggregate("strengths", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.nullif(F.size(F.filter("strengths", lambda x: x.isNotNull())), F.lit(0))
    out = found.groupBy("entity_id", "trait_id").agg(
        F.min("domain_id").alias("domain_id"), F.count(F.lit(1)).alias("evidence_count"), ordered.alias("strengths"), span.alias("span_days"), F.max("detected_at").alias("last_reinforced"),
    )
    out = out.filter(F.col("evidence_count") >= least).withColumn("initial", F.round(mean, 4)).withColumn("category", category(F.col("trait_id")))
    return out.withColumn("confidence", fold(F.col("initial"), F.col("strengths"))).withColumn("stability", stability(F.col("evidence_count"), F.col("span_days"), F.col("category"))).drop("strengths")


def decayed(confidence: Column, kind: Column, days: Column) -> Column:
    """ID-4: the rate a whole day, not below 0.2; under 0.15 is dormant."""
    c = F.when(days > 0, F.greatest(F.lit(FLOOR), confidence - T.lookup(vocab.CATEGORY_DECAY, kind, 0.01) * days)).otherwise(confidence)
    return F.when(c < DORMANT, 0.0).otherwise(c)


def reinforced(count: Column, kind: Column) -> Column:
    """ID-6: enough evidence for a shift."""
    return count >= T.lookup(vocab.CATEGORY_REINFORCE, kind, 3)


def suppressed(confidence: Column) -> Column:
    """ID-6."""
    return F.greatest(F.lit(DORMANT), confidence - PENALTY)


def activity(confidence: Column) -> Column:
    """ID-6."""
    return F.when(confidence >= FLOOR, "active").when((confidence < DORMANT) & (confidence > 0), "dormant").otherwise("inactive")


def global_confidence(all_: DataFrame, least: float = FLOOR) -> DataFrame:
    """AG-19."""
    return all_.filter(F.col("confidence") >= least).groupBy("entity_id").agg(F.round(F.avg("confidence"), 4).alias("global_confidence"))


def known_contradictions(all_: DataFrame, pairs: list[tuple[str, str]] = vocab.OPPOSITES, least: float = 0.4) -> DataFrame:
    """ID-7, JN-25: opposite traits that both are confident; a literal table of pairs, two joins on the entity."""
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("trait_a"), F.lit(b).alias("trait_b")) for a, b in pairs]))
    strong = all_.filter(F.col("confidence") >= least)
    a = strong.select("entity_id", F.col("trait_id").alias("trait_a"), F.col("confidence").alias("confidence_a"), rows.alias("p")).filter("trait_a = p.trait_a").select("entity_id", "trait_a", "confidence_a", F.col("p.trait_b").alias("trait_b"))
    b = strong.select("entity_id", F.col("trait_id").alias("trait_b"), F.col("confidence").alias("confidence_b"))
    both = a.join(b, ["entity_id", "trait_b"])
    return both.select("entity_id", "trait_a", "trait_b", "confidence_a", "confidence_b", F.round(F.least("confidence_a", "confidence_b") * 0.5, 4).alias("severity"))


def penalised(all_: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """ID-7: half the penalty a contradiction, and 0.2 from the fifth on."""
    hits = found.select("entity_id", F.explode(F.array("trait_a", "trait_b")).alias("trait_id")).groupBy("entity_id", "trait_id").agg(F.count(F.lit(1)).alias("contradictions"))
    out = all_.join(hits, ["entity_id", "trait_id"], "left").fillna(0, ["contradictions"])
    over = F.greatest(F.lit(0), F.col("contradictions") - (most - 1))
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.col("confidence") - F.col("contradictions") * (PENALTY / 2) - over * 0.2))


def text_contradictions(all_: DataFrame, texts: DataFrame, patterns: list[tuple[str, str]] = vocab.OPPOSITE_TEXTS, least: float = 0.3) -> DataFrame:
    """ID-8, JN-26: severity min(1, 2 x hits / checks) of trait pairs of a domain.

    Hits are products of pattern counts, so evidence texts are never paired:
    each trait needs its number of texts and of matches of every pattern."""
    low = F.lower("text")
    counts = [F.count_if(low.rlike(p)).alias(f"{side}{i}") for i, pair in enumerate(patterns) for side, p in zip("ab", pair, strict=True)]
    per = texts.groupBy("entity_id", "trait_id").agg(F.count(F.lit(1)).alias("n"), *counts)
    t = all_.filter(F.col("confidence") >= least).select("entity_id", "trait_id", "domain_id").join(per, ["entity_id", "trait_id"])
    x, y = t.select(*[F.col(c).alias(f"x_{c}") for c in t.columns]), t.select(*[F.col(c).alias(f"y_{c}") for c in t.columns])
    both = x.join(y, (F.col("x_entity_id") == F.col("y_entity_id")) & (F.col("x_domain_id") == F.col("y_domain_id")) & (F.col("x_trait_id") < F.col("y_trait_id")))
    hits = sum((F.col(f"x_a{i}") * F.col(f"y_b{i}") for i in range(1, len(patterns))), F.col("x_a0") * F.col("y_b0"))
    severity = F.least(F.lit(1.0), hits / (F.col("x_n") * F.col("y_n") * len(patterns)) * 2)
    return both.select(F.col("x_entity_id").alias("entity_id"), F.col("x_domain_id").alias("domain_id"), F.col("x_trait_id").alias("trait_a"), F.col("y_trait_id").alias("trait_b"), severity.alias("severity")).filter("severity > 0")


def resolved(confidence: Column, wins: Column, mean_so_far: Column, count: Column) -> Column:
    """ID-9: the winner gets an evidence of 0.9, the loser the penalty."""
    mean = (mean_so_far * count + 0.9) / (count + 1)
    return F.when(wins, F.round(confidence * 0.7 + mean * 0.3, 4)).otherwise(F.greatest(F.lit(0.0), confidence - PENALTY))


def weights(all_: DataFrame) -> DataFrame:
    """ID-10."""
    base = T.lookup(vocab.CATEGORY_WEIGHT, F.col("category"), 0.3) * T.lookup(vocab.DOMAIN_WEIGHT, F.col("domain_id"), 0.5)
    w = T.clamp(base * (0.5 * F.col("stability") + 0.5 * F.col("confidence")))
    part = lambda f: F.round(w * f, 4)
    return all_.filter("confidence >= 0.1").select("entity_id", "trait_id", part(1.0).alias("reasoning"), part(0.9).alias("retrieval"), part(0.85).alias("planning"), part(0.7).alias("emotional"))


def top_traits(all_: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """TK-10."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("stability"), F.desc("confidence"), "trait_id")
    return all_.filter(F.col("confidence") >= least).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def retrieval_boosts(queries: DataFrame, weighted: DataFrame, tags: DataFrame) -> DataFrame:
    """RET-24: 0.1 x the sum of retrieval weights of traits of which a tag occurs in the query.

    queries: query_id, entity_id, text; tags: entity_id, trait_id, tag (the trait's id is one)."""
    hit = queries.join(tags, "entity_id").filter(F.lower("text").contains(F.col("tag"))).select("query_id", "entity_id", "trait_id").distinct()
    return hit.join(weighted, ["entity_id", "trait_id"]).groupBy("query_id").agg((0.1 * F.sum("retrieval")).alias("identity_boost"))


def drift(versions: DataFrame, least: float = 0.1) -> DataFrame:
    """ID-11, JN-27, WN-4: trait changes between each entity's last two versions.

    versions: entity_id, version_number, trait_id, confidence."""
    last = versions.groupBy("entity_id").agg(F.max("version_number").alias("version_to"))
    v = versions.join(last, "entity_id").filter(F.col("version_number") >= F.col("version_to") - 1)
    now = F.max(F.when(F.col("version_number") == F.col("version_to"), F.col("confidence")))
    was = F.max(F.when(F.col("version_number") < F.col("version_to"), F.col("confidence")))
    out = v.groupBy("entity_id", "version_to", "trait_id").agg(was.alias("confidence_before"), now.alias("confidence_after"))
    delta = F.round(F.col("confidence_after") - F.col("confidence_before"), 4)
    kind = F.when(F.col("confidence_before").isNull(), "added").when(F.col("confidence_after").isNull(), "removed").when(F.abs(delta) > least, "changed")
    return out.withColumn("confidence_delta", delta).withColumn("change", kind).filter("change is not null and version_to > 1")


def snapshots(versions: DataFrame, keep: int = 50) -> DataFrame:
    """SNK-22, WN-10: the last ``keep`` versions an entity."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("version_number"))
    return versions.withColumn("_n", F.dense_rank().over(w)).filter(F.col("_n") <= keep).drop("_n")


def change_summary(changes: DataFrame) -> DataFrame:
    """ID-11: the first five changes, by trait."""
    item = (
        F.when(F.col("change") == "added", F.concat(F.lit("new:"), "trait_id"))
        .when(F.col("change") == "removed", F.concat(F.lit("removed:"), "trait_id"))
        .otherwise(F.concat("trait_id", F.when(F.col("confidence_delta") > 0, ":up:").otherwise(":down:"), F.format_number(F.abs("confidence_delta"), 2)))
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("trait_id", item.alias("i")))), lambda x: x["i"])
    return changes.groupBy("entity_id").agg(F.array_join(F.slice(listed, 1, 5), "; ").alias("summary"))


def rollback(versions: DataFrame, number: int) -> DataFrame:
    """ID-11."""
    return versions.filter(F.col("version_number") == number)


def label(trait: Column) -> Column:
    return F.initcap(F.replace(trait, F.lit("_"), F.lit(" ")))


def injection(all_: DataFrame, weighted: DataFrame, profiles: DataFrame, least: float = 0.3) -> DataFrame:
    """ID-12: what an agent is told of an entity: (entity_id, version, global_confidence, core_identity,
    preferred_style, length_preference, default_pattern, primary_drivers, planning_priorities,
    emotional_context, active_states, text).

    profiles: entity_id, version, global_confidence; under 0.1 nothing is told.
    Equal confidences go by the trait's id.  Each part is one aggregate over an
    entity's traits; traits are bounded, so arrays are small."""
    sure = F.col("confidence") >= least
    c, t, d = F.col("confidence"), F.col("trait_id"), F.col("domain_id")
    style = F.when(t.contains("concise") | t.contains("brief"), "concise").when(t.contains("detailed") | t.contains("thorough"), "detailed").when(t.contains("technical"), "technical")
    by = lambda keep, *what: F.sort_array(F.collect_list(F.when(keep, F.struct((-c).alias("c"), t.alias("t"), *what))))
    names = lambda a, f="t": F.transform(a, lambda x: x[f])
    told = all_.groupBy("entity_id").agg(
        by(sure & (d == "communication_style") & style.isNotNull(), style.alias("s")).alias("styles"), F.max(F.coalesce(sure & (d == "communication_style"), F.lit(False))).alias("speaks"),
        by(sure & (d == "decision_patterns") & t.contains("risk")).alias("risks"), F.max(F.coalesce(sure & (d == "decision_patterns"), F.lit(False))).alias("decides"),
        by(sure & d.isin("motivations", "long_term_drives")).alias("drivers"),
        F.sort_array(F.collect_set(F.when(F.col("category").isin("temporary", "adaptive"), t))).alias("active_states"),
    )
    top = top_traits(all_, 5, least).groupBy("entity_id").agg(names(F.sort_array(F.collect_list(F.struct("pos", t.alias("t"))))).alias("core"))
    plan = F.sort_array(F.collect_list(F.when(F.col("planning") > 0.3, F.struct((-F.col("planning")).alias("w"), t.alias("t")))))
    feel = F.sort_array(F.collect_list(F.when(F.col("emotional") > 0.1, F.struct(t.alias("t"), F.col("emotional").alias("w")))))
    weigh = weighted.groupBy("entity_id").agg(names(plan).alias("plan"), F.map_from_entries(feel).alias("feel"))
    known = F.col("global_confidence") >= 0.1
    j = profiles.join(told, "entity_id", "left").join(top, "entity_id", "left").join(weigh, "entity_id", "left")
    preferred = F.coalesce(F.get("styles", F.lit(0))["s"], F.lit("balanced"))
    none = F.array().cast("array<string>")
    out = j.select(
        "entity_id", "version", F.when(known, F.col("global_confidence")).otherwise(0.0).alias("global_confidence"),
        F.when(known, F.coalesce("core", none)).otherwise(none).alias("core_identity"),
        F.when(known & F.col("speaks"), preferred).alias("preferred_style"),
        F.when(known & F.col("speaks"), F.when(preferred == "concise", "concise").otherwise("detailed")).alias("length_preference"),
        F.when(known & F.col("decides"), F.coalesce(F.get("risks", F.lit(0))["t"], F.lit("balanced"))).alias("default_pattern"),
        F.when(known, F.transform(F.slice(names(F.coalesce("drivers", F.array())), 1, 3), label)).otherwise(none).alias("primary_drivers"),
        F.when(known, F.coalesce("plan", none)).otherwise(none).alias("planning_priorities"),
        F.when(known, F.col("feel")).alias("emotional_context"), F.when(known, F.coalesce("active_states", none)).otherwise(none).alias("active_states"),
    )
    line = lambda name, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"  {name}: "), value))
    first = lambda col, n: F.array_join(F.slice(col, 1, n), ", ")
    text = F.concat_ws(
        "\n",
        F.format_string("[identity_injection entity=%s v%d]", F.col("entity_id").cast("string"), "version"),
        line("Core identity", first(F.transform("core_identity", label), 3)),
        line("Communication", F.col("preferred_style")), line("Length", F.col("length_preference")),
        line("Decision style", F.col("default_pattern")), line("Drivers", first("primary_drivers", 2)),
        line("Planning focus", first("planning_priorities", 2)), F.lit("[/identity_injection]"),
    )
    return out.withColumn("text", text)


def updated(traits_: DataFrame, known: DataFrame, memories: DataFrame, least: float = 0.7, **words) -> tuple[DataFrame, DataFrame]:
    """ID-13: traits after new memories, and all evidence with theirs.

    traits_: as ``traits`` makes them; known: the evidence they rest on.  Each
    new evidence of a trait (not of a domain) reinforces the trait where the
    entity has it: count, span and stability are made again from all its
    evidence, the confidence stays.  A trait that it has not is added only for a
    strength of ``least`` in a memory that shows two things at least, with half
    its confidence."""
    new = evidence(memories, **words)
    shows = F.count(F.lit(1)).over(Window.partitionBy("entity_id", "memory_id"))
    new = new.withColumn("shows", shows).filter(~F.col("trait_id").startswith("domain_"))
    have = traits_.select("entity_id", "trait_id")
    old = new.join(have, ["entity_id", "trait_id"], "left_semi")
    strong = new.filter((F.col("strength") >= least) & (F.col("shows") >= 2)).join(have, ["entity_id", "trait_id"], "left_anti")
    first = strong.groupBy("entity_id", "trait_id").agg(F.min_by("strength", F.struct("detected_at", "memory_id")).alias("s"), F.min("domain_id").alias("domain_id"))
    added = first.select("entity_id", "trait_id", "domain_id", (F.col("s") * 0.5).alias("confidence"))
    every = known.unionByName(old.unionByName(strong).select(*known.columns))
    span = (F.unix_micros(F.max("detected_at").cast("timestamp")) - F.unix_micros(F.min("detected_at").cast("timestamp"))) / 86_400_000_000.0
    seen = every.groupBy("entity_id", "trait_id").agg(F.count(F.lit(1)).alias("evidence_count"), span.alias("span_days"), F.max("detected_at").alias("last_reinforced"))
    all_ = traits_.select("entity_id", "trait_id", "domain_id", "confidence").unionByName(added).withColumn("category", category(F.col("trait_id")))
    made = all_.join(seen, ["entity_id", "trait_id"])
    return made.withColumn("stability", stability(F.col("evidence_count"), F.col("span_days"), F.col("category"))), every


def next_version(traits_: DataFrame, versions: DataFrame | None, keep: int = 50) -> DataFrame:
    """ID-14: an entity's traits as its next version, beside those kept (entity_id, version_number, trait_id, confidence)."""
    cols = ["entity_id", "version_number", "trait_id", "confidence"]
    if versions is None:
        return traits_.withColumn("version_number", F.lit(1)).select(*cols)
    last = versions.groupBy("entity_id").agg(F.max("version_number").alias("last"))
    new = traits_.join(last, "entity_id", "left").withColumn("version_number", F.coalesce("last", F.lit(0)) + 1)
    return snapshots(versions.select(*cols).unionByName(new.select(*cols)), keep)
