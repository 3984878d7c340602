"""EP-1 to EP-14, AG-11 to AG-16: scoring, consolidation, distillation, quality and validation of episodes and notes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import vocab


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def emotions(text: Column, words: Mapping[str, Sequence[str]] = vocab.EMOTION_WORDS) -> dict[str, Column]:
    """EP-2: the share of each list's words that occur."""
    low = _low(text)
    return {k: T.contains_count(low, v) / float(len(v)) for k, v in words.items()}


def intensity(parts: list[Column]) -> Column:
    """AG-24: the mean of the dimensions."""
    return sum(parts[1:], parts[0]) / float(len(parts))


def dominant(parts: Mapping[str, Column]) -> Column:
    """AG-24: the largest dimension, the first of equals."""
    best = F.greatest(*parts.values())
    return F.coalesce(*[F.when(v == best, F.lit(k)) for k, v in parts.items()])


def goal_relevance(text: Column, words: Sequence[str] = vocab.GOAL_WORDS) -> Column:
    return F.least(F.lit(1.0), T.contains_count(_low(text), words) / float(len(words)) * 2)


def repetition(mentions: Column) -> Column:
    return F.least(F.lit(1.0), mentions / 5.0)


def weighted(emotion: Column, novelty: Column, goal: Column, repeated: Column) -> Column:
    return F.round(S.clamp(emotion * 0.3 + novelty * 0.2 + goal * 0.3 + repeated * 0.2), 4)


def importance_a(text: Column, mentions: Column, words: Mapping[str, Sequence[str]] = vocab.EMOTION_WORDS, goals: Sequence[str] = vocab.GOAL_WORDS) -> Column:
    """EP-3."""
    own = F.array_distinct(T.split_words(_low(text)))
    new = F.size(F.array_except(own, F.array(*map(F.lit, vocab.PLAIN_WORDS))))
    novelty = F.least(F.lit(1.0), new / F.greatest(F.size(own), F.lit(1)) * 3)
    return weighted(intensity(list(emotions(text, words).values())), novelty, goal_relevance(text, goals), repetition(mentions))


def keyword_emotion(text: Column) -> Column:
    """EP-4 without a state: weights of words that occur, by the number of words."""
    low, n = _low(text), float(len(vocab.EMOTION_WEIGHTS))
    hit = [F.when(low.contains(w), F.lit(v)).otherwise(0.0) for w, v in vocab.EMOTION_WEIGHTS.items()]
    return F.least(F.lit(1.0), sum(hit[1:], hit[0]) / n)


def significant(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(_low(text), F.lit(r"\b([a-z]{2,})\b"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, vocab.COMMON_WORDS)))


def novelty(text: Column, corpus: Column | None = None) -> Column:
    """EP-4, AG-23: share of significant words not in the corpus' vocabulary, or x 1.5 of all words."""
    found = F.array_distinct(F.regexp_extract_all(_low(text), F.lit(r"\b([a-z]{2,})\b"), F.lit(1)))
    own = significant(text)
    if corpus is not None:
        return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_except(own, corpus)) / F.size(own))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(own) / F.size(found) * 1.5))


def importance_b(text: Column, emotion: Column | None, mentions: Column, corpus: Column | None = None) -> Column:
    """EP-4."""
    return weighted(keyword_emotion(text) if emotion is None else emotion, novelty(text, corpus), goal_relevance(text), repetition(mentions))


def threshold(category: Column) -> Column:
    """EP-5: by the category's name inside the text given; 0.25 without one."""
    c = F.lower(category)
    return F.when(category.isNull(), 0.25).when(c.contains("episodic"), 0.3).when(c.contains("reflection"), 0.4).otherwise(0.0)


def typed(category: Column, text: Column, at: Column, importance: Column) -> Column:
    """EP-6: the fields that a memory of a category has."""
    name = T.truncate_words(text, 60)
    one = lambda kind, v: F.when(category == kind, v)
    return F.struct(
        category.alias("category"), T.truncate_words(text, 120).alias("summary"), at.alias("at"), importance.alias("importance"),
        one("goal", name).alias("goal"), one("procedural", name).alias("procedure"), one("reflection", T.truncate_words(text, 100)).alias("insight"),
        one("identity", name).alias("trait"), one("relationship", name).alias("dynamics"),
    )


def cluster_key(text: Column, event_type: Column, participants: Column) -> Column:
    """AG-11: first link or event type, with the first three participants, sorted."""
    link = F.regexp_extract(text, T.LINK, 1)
    topic = F.when(link != "", F.lower(link)).otherwise(event_type)
    people = F.array_join(F.sort_array(F.slice(participants, 1, 3)), "|")
    return F.when(F.size(participants) > 0, F.concat_ws(":", topic, people)).otherwise(topic)


def clusters(scored: DataFrame) -> DataFrame:
    """AG-12, AG-14: a row a cluster of (cluster_key, id, event_type, participants, platform, lessons, score)."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = scored.groupBy("cluster_key").agg(
        F.sort_array(F.collect_set("event_type")).alias("event_types"), flat("participants").alias("participants"), F.sort_array(F.collect_set("platform")).alias("tools"),
        flat("lessons").alias("lessons"), F.round(F.avg("score"), 4).alias("avg_importance"), F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("id")).alias("memory_ids"),
    )
    first = F.array_join(F.slice("lessons", 1, 3), ", ")
    label = F.when(F.size("lessons") > 0, F.concat(F.lit("Pattern from "), F.col("count").cast("string"), F.lit(" interactions: "), first)).otherwise("No lessons extracted")
    return out.withColumn("promoted", F.col("count") >= 3).withColumn("summary", label)


def keepers(scored: DataFrame) -> DataFrame:
    """AG-13: the member of largest score of each cluster and how many others are pruned (an aggregate, no sort)."""
    return scored.groupBy("cluster_key").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("keeper"), (F.count(F.lit(1)) - 1).alias("pruned"))


def retention(scored: DataFrame) -> DataFrame:
    """AG-15, EP-7, EP-8: totals of a consolidation over (score, threshold, cluster_key)."""
    kept = F.count_if(F.col("score") >= F.col("threshold"))
    n = F.count(F.lit(1))
    return scored.agg(n.alias("total"), kept.alias("retained"), (n - kept).alias("pruned"), F.count_distinct("cluster_key").alias("clusters"), F.round(kept / F.greatest(n, F.lit(1)) * 100, 0).alias("retention_rate"))


def distill_actions(age: Column, importance: Column, lifecycle: Column) -> Column:
    """EP-10: archive stands alone; summarise and promote can both happen."""
    early = lifecycle.isin("raw", "summarized")
    archive = (age > 14) & (importance < 0.3) & early
    acts = F.array(F.when(archive, "archive"), F.when(~archive & (age > 2) & (lifecycle == "raw"), "summarize"), F.when(~archive & (importance >= 0.75) & early, "promote"))
    return F.filter(acts, lambda a: a.isNotNull())


def promoted_entities(references: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """EP-11, AG-16, JN-24: entities referenced by at least two notes that have no note yet."""
    n = references.select("entity", "note").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("notes")).filter(F.col("notes") >= least)
    return n.join(known.select("entity"), "entity", "left_anti")


def quality(text: Column) -> Column:
    """EP-12: (score, grade, word_count, wikilinks)."""
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    has = text.rlike(r"(?s)\A---\n.*?\n---\n")
    body = F.when(has, F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")).otherwise(text)
    links = F.size(F.regexp_extract_all(text, F.lit(T.LINK), F.lit(1)))
    words = F.size(T.split_words(body))
    heads = body.rlike(r"(?m)^#{1,3}\s+")
    points = (
        F.when(has, 1.5).otherwise(0.0)
        + sum((F.when(front.contains(k), 0.5).otherwise(0.0) for k in ("date:", "tags:")), F.when(front.contains("type:"), 0.5).otherwise(0.0))
        + F.when(links >= 1, F.least(F.lit(1.5), links * 0.3)).otherwise(0.0)
        + F.when(heads, 0.5).otherwise(0.0)
        + F.when(body.rlike(r"(?m)^[-*]\s+"), 0.5).otherwise(0.0)
        + F.when(F.regexp_count(body, F.lit("```")) >= 2, 0.5).otherwise(0.0)
        + F.when((words >= 50) & (words <= 1500), 1.0).when(words < 20, 0.0).otherwise(0.3)
        - F.when((words > 300) & ~heads, 1.0).otherwise(0.0)
    )
    s = S.clamp(points / 10.0)
    grade = F.when(s >= 0.8, "A").when(s >= 0.6, "B").when(s >= 0.4, "C").when(s >= 0.2, "D").otherwise("F")
    return F.struct(F.round(s, 3).alias("score"), grade.alias("grade"), words.alias("word_count"), links.alias("wikilinks"))


def issues(raw: Column, meta_error: Column, memory_id: Column, kind: Column, body: Column) -> Column:
    """EP-13: (code, severity) of what is wrong with a note."""
    uuid = "(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
    links = F.regexp_count(raw, F.lit(T.LINK))
    note = lambda cond, code, severity: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    no_kind = F.coalesce(F.trim(kind), F.lit("")) == ""
    found = F.array(
        note(raw.isNull(), "READ_ERROR", "error"),
        note(meta_error.isNotNull(), "MALFORMED_FRONTMATTER", "error"),
        note(~raw.startswith("---"), "MISSING_FRONTMATTER", "error"),
        note(memory_id.isNull(), "MISSING_EXPLICIT_MEMORY_ID", "warning"),
        note(memory_id.isNotNull() & ~memory_id.rlike(uuid), "INVALID_MEMORY_ID", "error"),
        note(no_kind, "MISSING_TYPE", "warning"),
        note(~no_kind & ~F.lower(kind).isin(list(vocab.MEMORY_TYPES)), "NON_STANDARD_TYPE", "info"),
        note((links == 0) & (F.size(T.split_words(body)) > 50), "ORPHAN_CONTENT", "warning"),
        note(~body.contains("# ") & (F.trim(body) != ""), "MISSING_TITLE_HEADER", "info"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def unresolved_links(notes: DataFrame, known: DataFrame) -> DataFrame:
    """JN-23, EP-13: (path, target) of links to no known title, path or alias."""
    each = notes.select("path", F.explode(F.regexp_extract_all("raw", F.lit(T.LINK), F.lit(1))).alias("l"))
    each = each.select("path", F.trim(F.substring_index("l", "|", 1)).alias("target")).filter("target <> ''")
    return each.join(known.select(F.col("name").alias("target")).distinct(), "target", "left_anti")


def issue_totals(found: DataFrame) -> DataFrame:
    """AG-21: a row a (severity, code) of (path, issues)."""
    return found.select("path", F.explode("issues").alias("i")).groupBy("i.severity", "i.code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("notes"))
