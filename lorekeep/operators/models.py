"""UX-3 to UX-7, ST-11: plug-ins for language, embedding and rerank models.

A provider is a Python callable over a batch; it runs in Arrow batches on the
executors.  Without one, or where it fails on a row, the heuristic answers.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import embed_udf


def generate(prompt: Column, fallback: Column, provider: Callable[[list[str]], list[str | None]] | None) -> Column:
    """UX-3: the provider's text for each prompt, the fallback where it has none or fails."""
    if provider is None:
        return fallback

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            try:
                made = provider(["" if x is None else x for x in s])
            except Exception:  # noqa: BLE001  a model that is down must not end the job
                made = [None] * len(s)
            yield pd.Series(made, dtype=object)

    return F.coalesce(call(prompt), fallback)


def structured(prompt: Column, schema: str, provider: Callable[[list[str]], list[str | None]]) -> Column:
    """UX-3: JSON of a schema; null where the answer isn't of it."""
    answer = generate(prompt, F.lit(None).cast("string"), provider)
    bare = F.regexp_replace(answer, r"(?s)^.*?```(?:json)?\s*|\s*```.*$", "")
    return F.from_json(bare, schema, {"mode": "PERMISSIVE"})


def mock(prompts: list[str]) -> list[str]:
    """UX-3: a provider for tests: says what it was asked, as JSON."""
    return [json.dumps({"echo": p[:40]}) for p in prompts]


def summaries(notes: DataFrame, provider=None) -> DataFrame:
    """EP-10's summary: (path, summary), heuristic without a model."""
    prompt = F.concat(F.lit("Summarise this log in a few sentences.\n\n"), "body")
    return notes.select("path", generate(prompt, T.heuristic_summary(F.col("body")), provider).alias("summary"))


def lessons(notes: DataFrame, provider=None) -> DataFrame:
    """EP-10's lessons: (path, lessons)."""
    heuristic = T.lessons(F.col("body"))
    if provider is None:
        return notes.select("path", heuristic.alias("lessons"))
    found = structured(F.concat(F.lit('List reusable lessons as JSON {"lessons": [...]}.\n\n'), "body"), "lessons array<string>", provider)["lessons"]
    return notes.select("path", F.when(F.size(found) > 0, found).otherwise(heuristic).alias("lessons"))


def written(requests: DataFrame, provider=None) -> DataFrame:
    """UX-4: (id, title, body) to write for an input; the text as it is without a model."""
    plain = F.struct(T.title(F.col("text")).alias("title"), F.col("text").alias("body"))
    if provider is None:
        return requests.select("id", plain.alias("n")).select("id", "n.*")
    made = structured(F.concat(F.lit('Write a note as JSON {"title": ..., "body": ...}.\n\n'), "text"), "title string, body string", provider)
    return requests.select("id", F.when(made["body"].isNotNull(), made).otherwise(plain).alias("n")).select("id", "n.*")


def reflection_prompts(memories: DataFrame, most: int = 10, chars: int = 500) -> DataFrame:
    """UX-5: one prompt a topic of its latest ten memories, 500 characters each (topic, at, id, text)."""
    w = Window.partitionBy("topic").orderBy(F.desc("at"), "id")
    top = memories.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    lines = F.sort_array(F.collect_list(F.struct("n", F.substring("text", 1, chars).alias("t"))))
    return top.groupBy("topic").agg(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["t"])), "\n").alias("prompt"))


def reflect(memories: DataFrame, provider=None) -> DataFrame:
    """UX-5: (topic, reflection)."""
    p = reflection_prompts(memories)
    return p.select("topic", generate(p["prompt"], T.heuristic_summary(F.col("prompt")), provider).alias("reflection"))


def cached_embeddings(texts: DataFrame, cache: DataFrame | None, model: str, provider=None, dim: int = 384) -> tuple[DataFrame, DataFrame]:
    """ST-11, UX-1: (id, vec) of texts, and the rows to append to the cache (text_hash, model, vec).

    Texts are embedded once a distinct hash; known ones come from the cache by a join."""
    hashed = texts.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    known = None if cache is None else cache.filter(F.col("model") == model).select("text_hash", "vec")
    todo = hashed.dropDuplicates(["text_hash"]).select("text_hash", "text")
    todo = todo if known is None else todo.join(known.select("text_hash"), "text_hash", "left_anti")
    new = todo.select("text_hash", F.lit(model).alias("model"), embed_udf(provider, dim)("text").alias("vec"))
    every = new.select("text_hash", "vec") if known is None else known.unionByName(new.select("text_hash", "vec"))
    return hashed.join(every, "text_hash").select("id", "vec"), new
