"""PRJ-1, PRJ-2, PRJ-8 to PRJ-11, WN-7, WN-8, WN-11: notes to records and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..functions.udfs import front_matter_udf

MOST = 1500


def parsed(notes: DataFrame) -> DataFrame:
    """PRJ-1, PRJ-2: (path, raw) -> the record's columns; ``error`` for malformed front matter (quarantine)."""
    out = notes.withColumn("_p", front_matter_udf()("raw")).select(*notes.columns, "_p.meta", "_p.body", "_p.error")
    get = lambda name: F.get_json_object("meta", f"$.{name}")

    def strings(name: str) -> Column:
        one, many = get(name), F.from_json(get(name), "array<string>")
        listed = F.coalesce(F.when(one.startswith("["), many), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
        nested = F.transform(listed, lambda x: F.regexp_replace(x, r'^[\["\]]+|[\["\]]+$', ""))
        return T.string_list(F.coalesce(nested, F.array().cast("array<string>")))

    rels = F.from_json(get("relationships"), "array<map<string,string>>")
    return out.select(
        *notes.columns, "error", "body",
        I.memory_id(get("memory_id"), T.vault_path(F.col("path"))).alias("memory_id"),
        T.memory_type(get("type")).alias("memory_type"), T.document_status(F.col("path"), get("status")).alias("doc_status"),
        T.title(F.col("body")).alias("title"), *[strings(c).alias(c) for c in ("aliases", "tags", "entities", "related_to")],
        F.coalesce(T.relationships(rels), F.array().cast("array<struct<predicate:string,target:string,status:string>>")).alias("relationships"),
        F.coalesce(get("timestamps.created"), get("date")).alias("created"), F.coalesce(get("timestamps.updated"), get("updated")).alias("updated"), get("timestamps.occurred").alias("occurred"),
        get("source_agent").alias("source_agent"), get("project").alias("project"), F.from_json(get("profile_facts"), "map<string,string>").alias("profile_facts"),
        I.content_hash(F.col("raw")).alias("content_hash"),
    )


def sections(notes: pd.DataFrame) -> pd.DataFrame:
    """Structural sections of notes (path, body): the note's number, its ordinal, ``heading_path``, ``text``.

    All lines of all notes are one column.  Fence parity and the number of the
    section are running sums over it, so a heading in a fence is a line like
    any other; a heading's path is what its level leaves of the path before
    it.  The first H1 (or the file's stem) leads every path.
    """
    line = notes["body"].fillna("").str.split("\n").explode()
    note = line.index.to_series().set_axis(range(len(line)))
    line = line.set_axis(range(len(line)))
    fence = line.str.strip().str.startswith("```")
    inside = fence.astype(int).groupby(note).cumsum() % 2 == 1
    head = line.str.extract(r"^(#{1,6})\s(.*)$").set_axis(["marks", "title"], axis=1)
    title, level = head["title"].str.strip(), head["marks"].str.len()
    heading = level.notna() & ~fence & ~inside
    number = heading.astype(int).groupby(note).cumsum()
    text = line[~heading].groupby([note[~heading], number[~heading]], sort=True).agg("\n".join).str.strip()
    text = text[text != ""]
    stem = notes["path"].fillna("").str.rsplit("/", n=1).str[-1].str.replace(r"\.[^.]*$", "", regex=True)
    first = title[level == 1].groupby(note[level == 1]).first()
    lead = first.reindex(notes.index).where(lambda x: x.notna(), stem).replace("", "Memory")
    below = lambda path, at: (*path[: at[0] - 1], at[1])
    paths: dict[int, list[tuple[str, ...]]] = {}
    for n, own in pd.DataFrame({"level": level[heading].astype(int), "title": title[heading]}).groupby(note[heading]):
        paths[n] = list(accumulate(own.itertuples(index=False), below, initial=()))
    path = [paths.get(n, [()])[k] for n, k in text.index]
    full = [list(p) if p[:1] == (lead[n],) else [lead[n], *p] for p, (n, _) in zip(path, text.index, strict=True)]
    return pd.DataFrame({"note": [n for n, _ in text.index], "heading_path": full, "text": text.to_list()})


def split_long(text: str, most: int = MOST) -> list[str]:
    """PRJ-9: paragraphs packed up to ``most`` characters; the last one of a part also starts the next.

    The state of a paragraph is its part, where that starts, and its size so
    far; a part so ends where the next one starts."""
    paragraphs = re.split(r"\n\n+", text)
    size = [len(p) for p in paragraphs]

    def state(before: tuple[int, int, int], i: int) -> tuple[int, int, int]:
        part, start, used = before
        return (part, start, used + size[i]) if used + size[i] <= most else (part + 1, i - 1, size[i - 1] + size[i])

    starts = list({part: start for part, start, _ in accumulate(range(1, len(paragraphs)), state, initial=(0, 0, size[0]))}.values())
    ends = [*starts[1:], len(paragraphs) - 1]
    return ["\n\n".join(paragraphs[a : b + 1]) for a, b in zip(starts, ends, strict=True)]


def _cut(notes: pd.DataFrame, most: int) -> pd.DataFrame:
    """The chunks of notes: (note, ordinal, heading_path, text)."""
    made = sections(notes)
    made = made.assign(text=[split_long(t, most) for t in made["text"]]).explode("text", ignore_index=True)
    return made.assign(text=[t.strip() for t in made["text"]], ordinal=made.groupby("note").cumcount())


def chunks(notes: DataFrame, most: int = MOST) -> DataFrame:
    """PRJ-8: chunks of notes (memory_id, path, body, content_hash): structural
    sections, split where long, with heading context.  A map over notes; no shuffle."""
    keys = ["memory_id", "path", "content_hash"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = _cut(b, most)
            yield pd.concat([b.loc[made["note"], keys].reset_index(drop=True), made[["ordinal", "heading_path", "text"]]], axis=1)

    schema = "memory_id string, path string, content_hash string, ordinal int, heading_path array<string>, text string"
    made = notes.select("memory_id", "path", "content_hash", "body").mapInPandas(cut, schema)
    return made.select(
        I.chunk_id(F.col("memory_id"), F.col("content_hash"), F.col("ordinal")).alias("chunk_id"), "memory_id", "path", "ordinal", "heading_path",
        F.concat(T.heading_context(F.col("heading_path")), F.lit("\n\n"), "text").alias("content"), T.links(F.col("text")).alias("entities"), T.tags(F.col("text")).alias("tags"),
        I.chunk_label(F.col("path"), F.col("heading_path"), F.col("ordinal")).alias("label"),
    )


def pack_lines(lines: Column, most: int) -> Column:
    """PRJ-9 as an expression: greedy parts of up to ``most`` characters (without overlap)."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("part"), F.lit(0).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["part"]) > 0) & (acc["size"] + F.length(x) > most)
        done = F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["part"], "\n")))).otherwise(acc["done"])
        part = F.when(full, F.array(x)).otherwise(F.concat(acc["part"], F.array(x)))
        size = F.when(full, F.length(x)).otherwise(acc["size"] + F.length(x))
        return F.struct(done.alias("done"), part.alias("part"), size.alias("size"))

    return F.aggregate(lines, zero, step, lambda acc: F.when(F.size(acc["part"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["part"], "\n")))).otherwise(acc["done"]))


def chunk_udtf():
    """UX-8: the chunker as a table function: (path, body) -> (ordinal, heading_path, text); for ``spark.udtf.register``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="ordinal int, heading_path array<string>, text string")
    class Chunks:
        def eval(self, path: str, body: str):
            made = _cut(pd.DataFrame({"path": [path], "body": [body]}), MOST)
            yield from made[["ordinal", "heading_path", "text"]].itertuples(index=False, name=None)

    return Chunks
