"""EP-8 to EP-11, SNK-20: whole-vault jobs: distil, consolidate, promote, give ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import scores as S
from ..functions import text as T
from ..sources.vault import daily_note
from . import episodes, models


def with_ids(notes: DataFrame) -> DataFrame:
    """SNK-20: the stated id, else the one of the path; running it again changes nothing."""
    return notes.withColumn("memory_id", I.memory_id(F.col("memory_id"), T.vault_path(F.col("path"))))


def distil(notes: DataFrame, today: Column, provider=None) -> DataFrame:
    """EP-10: daily notes (path, body, date, lifecycle, base_importance) with their
    next state, path and body, and the procedure that a promoted one gives."""
    day = notes.filter(daily_note(F.col("path")))
    age = F.date_diff(today, F.coalesce(F.to_date("date"), today))
    state = F.coalesce("lifecycle", F.lit("raw"))
    imp = S.aged_importance(F.coalesce("base_importance", F.lit(0.5)), F.regexp_count("body", F.lit(T.LINK)), age)
    acts = day.withColumn("importance", imp).withColumn("actions", episodes.distill_actions(age, imp, state))
    has = lambda a: F.array_contains("actions", a)
    summary = models.generate(F.col("body"), T.heuristic_summary(F.col("body")), provider)
    body = F.when(has("summarize"), F.concat(F.lit("# Distilled Summary\n"), summary, F.lit("\n\n## Raw Logs\n"), "body")).otherwise(F.col("body"))
    stem = F.regexp_extract("path", r"([^/]*?)\.md$", 1)
    lessons = F.array_join(F.transform(T.lessons(F.col("body")), lambda x: F.concat(F.lit("- "), x)), "\n")
    procedure = F.concat(F.lit("# Extracted Procedure\n\n## Lessons Learned\n"), lessons, F.lit("\n\n## Context\nGenerated from [["), stem, F.lit("]]."))
    return acts.select(
        "path", "importance", "actions",
        F.when(has("archive"), "archived").when(has("promote"), "distilled").when(has("summarize"), "summarized").otherwise(state).alias("lifecycle"),
        F.when(has("archive"), F.concat(F.lit("Archive/"), stem, F.lit(".md"))).otherwise(F.col("path")).alias("new_path"),
        F.when(has("archive"), F.col("body")).otherwise(body).alias("new_body"),
        F.when(has("promote"), F.concat(F.lit("Procedures/PROC_"), F.replace(stem, F.lit("-"), F.lit("_")), F.lit(".md"))).alias("procedure_path"),
        F.when(has("promote"), procedure).alias("procedure"),
    )


def daily_memories(notes: DataFrame, people: tuple[str, ...] = ()) -> DataFrame:
    """EP-9: daily notes (path, body) as episodic memories: lessons are their bullet lines, participants the listed names that occur."""
    bullets = F.transform(F.filter(F.split("body", "\n"), lambda x: x.startswith("- ")), lambda x: T.strip(F.substring(x, 3, 1_000_000)))
    there = F.filter(F.array(*[F.when(F.lower("body").contains(p.lower()), F.lit(p)) for p in people]).cast("array<string>"), lambda x: x.isNotNull())
    day = notes.filter(daily_note(F.col("path")))
    made = day.select(F.col("path").alias("id"), F.lit("daily").alias("event_type"), there.alias("participants"), F.lit("vault").alias("platform"), bullets.alias("lessons"), "body")
    score = episodes.importance_b(F.col("body"), None, F.lit(0))
    return made.withColumn("score", score).withColumn("cluster_key", episodes.cluster_key(F.col("body"), F.col("event_type"), F.col("participants")))


def concepts(memories: DataFrame) -> DataFrame:
    """EP-9, AG-14: (path, note) of the concepts that clusters of three or more give."""
    c = episodes.clusters(memories).filter("promoted")
    lines = lambda col: F.array_join(F.transform(col, lambda x: F.concat(F.lit("- "), x)), "\n")
    note = F.concat(F.lit("# "), "cluster_key", F.lit("\n\n"), "summary", F.lit("\n\n## Lessons\n"), lines("lessons"), F.lit("\n\n## Sources\n"), lines("memory_ids"), F.lit("\n"))
    return c.select(F.concat(F.lit("Concepts/"), T.slug(F.col("cluster_key")), F.lit(".md")).alias("path"), note.alias("note"))


def promoted_notes(references: DataFrame, known: DataFrame) -> DataFrame:
    """EP-11: (path, note) of entities that two daily notes name and that have no note."""
    found = episodes.promoted_entities(references, known)
    by = references.select("entity", "note").distinct().join(found.select("entity"), "entity", "left_semi").groupBy("entity").agg(F.sort_array(F.collect_set("note")).alias("notes"))
    listed = F.array_join(F.transform("notes", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    note = F.concat(F.lit("# "), "entity", F.lit("\n\n## Summary\nNamed by "), F.size("notes").cast("string"), F.lit(" daily notes.\n\n## Referenced Daily Notes\n"), listed, F.lit("\n"))
    return by.select(F.concat(F.lit("Concepts/"), "entity", F.lit(".md")).alias("path"), note.alias("note"))
