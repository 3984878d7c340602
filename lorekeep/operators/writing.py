"""SNK-17, SNK-18, RET-18, JN-30: decisions of the write path."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import batch
from .dense import nearest
from .lexical import top_k


def note(text: Column) -> Column:
    """Title, slug and normalised body of a text."""
    t = T.title(text)
    return F.struct(t.alias("title"), T.slug(t).alias("slug"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("body"))


def write_decisions(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, decision, match_path): ADD, UPDATE or NOOP.

    incoming: id, category, text, dedup; existing: path, text.  A note of the
    same slug or of the same title without case matches: two equi-joins, the
    first path of all matches.  Its body holding the incoming one is a NOOP."""
    new = incoming.withColumn("n", note(F.col("text"))).select("id", F.lower("category").alias("category"), F.coalesce("dedup", F.lit(False)).alias("dedup"), "n.*")
    old = existing.withColumn("n", note(F.col("text"))).select("path", F.col("n.slug").alias("o_slug"), F.lower(F.trim("n.title")).alias("o_title"), F.col("n.body").alias("o_body"))
    keyed = new.filter(~F.col("category").isin("episodic", "daily") | F.col("dedup"))
    by_slug = keyed.join(old, F.col("slug") == F.col("o_slug")).select("id", "path", "body", "o_body")
    by_title = keyed.join(old, F.lower(F.trim("title")) == F.col("o_title")).select("id", "path", "body", "o_body")
    held = F.col("o_body").contains(F.col("body"))
    first = by_slug.unionByName(by_title).groupBy("id").agg(F.min(F.struct("path", held.alias("held"))).alias("m"))
    out = new.select("id").join(first, "id", "left")
    return out.select("id", F.when(F.col("m").isNull(), "ADD").when(F.col("m.held"), "NOOP").otherwise("UPDATE").alias("decision"), F.col("m.path").alias("match_path"))


def updated_body(old: Column, new: Column, title: Column, day: Column) -> Column:
    """RET-18: the old body with a dated section of the new one (without its title line)."""
    head = F.concat(F.lit("# "), title)
    bare = T.strip(new)
    rest = T.strip(F.when(bare.startswith(head), F.substr(bare, F.length(head) + 1)).otherwise(bare))
    return F.concat(T.strip(old), F.lit("\n\n## Update ("), F.date_format(day, "yyyy-MM-dd"), F.lit(")\n"), rest)


def edit(text: Column, old: Column, new: Column, expected_hash: Column | None = None) -> Column:
    """SNK-18: (text, outcome): the first occurrence replaced; ``conflict`` if the hash differs, ``not_found`` without one."""
    at = F.instr(text, old)
    conflict = F.lit(False) if expected_hash is None else F.sha2(text, 256) != expected_hash
    changed = F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))
    outcome = F.when(conflict, "conflict").when(at == 0, "not_found").otherwise("edited")
    return F.struct(F.when(outcome == "edited", changed).otherwise(text).alias("text"), outcome.alias("outcome"))


def add_link(text: Column, target: Column) -> Column:
    """SNK-18: no-op if the link is there."""
    link = F.concat(F.lit("[["), target, F.lit("]]"))
    return F.when(F.contains(text, link), text).otherwise(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n"), link, F.lit("\n")))


def archived_path(path: Column) -> Column:
    """SNK-18: soft delete moves a note under Archive/."""
    return F.when(path.startswith("Archive/"), path).otherwise(F.concat(F.lit("Archive/"), path))


#: A term stands within one run of these, so a note's occurrences are those of its runs.
RUN = re.compile("[a-z0-9_]{3,}")
#: Runs of notes whose terms a task keeps.
KEPT_RUNS = 400_000


class _Held(dict):
    """A run of a note -> (code, occurrences) of the terms it holds; forgets all when it has grown."""

    def __init__(self, vocab: list[str]) -> None:
        self.by: dict[str, list[tuple[int, str]]] = {}
        for code, term in enumerate(vocab):
            self.by.setdefault(term[:3], []).append((code, term))

    def __missing__(self, run: str) -> list[tuple[int, int]]:
        if len(self) > KEPT_RUNS:
            self.clear()
        heads = {run[i : i + 3] for i in range(len(run) - 2)}
        out = self[run] = [(code, run.count(term)) for h in heads for code, term in self.by.get(h, ()) if term in run]
        return out


def _counted(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The k best notes a task of each batch, by the occurrences of its terms."""
    blocks = [(ids, terms, _Held(terms.vocab.to_pylist())) for ids, terms in batch.blocks(asked, "own")]
    for b in batches:
        low, paths, texts = (batch.column(b, c) for c in ("low", "path", "text"))
        for ids, terms, held in blocks:
            tasks, v = len(ids), len(terms.vocab)
            ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(low).cast(pa.int64()), 0)).to_numpy()
            for lo, hi in batch.parts(ends, batch.PLACES, batch.CELLS // tasks):
                found = [(d * v + code, n) for d, t in enumerate(low.slice(lo, hi - lo).to_pylist()) if t for run in RUN.findall(t) for code, n in held[run]]
                each = np.array(found, np.int64).reshape(-1, 2)
                cell, at = np.unique(each[:, 0], return_inverse=True)
                n = np.bincount(at, each[:, 1], len(cell))
                i, at = batch.expanded(terms.starts, cell % v)
                score = np.bincount((cell // v)[i] * tasks + terms.query[at], n[i], (hi - lo) * tasks).reshape(hi - lo, tasks)
                task, row = nearest(score.T, batch.ranks(paths.slice(lo, hi - lo)), k)
                some = score[row, task] > 0
                task, row = task[some], row[some]
                at = pa.array(row + lo)
                cols = [ids.take(pa.array(task)), pa.array(score[row, task].astype(np.int64)), paths.take(at), texts.take(at)]
                yield pa.RecordBatch.from_arrays(cols, names=["task_id", "score", "path", "text"])


def procedures(tasks: DataFrame, notes: DataFrame, k: int = 4, rules: str = "AGENTS.md") -> DataFrame:
    """RET-20, TK-9: (task_id, pos, block): the rules note first, then notes by term count.

    tasks: task_id, text; notes: path, text.  Tasks are broadcast (see
    ``batch``); a note's runs of letters are searched for all terms at once, as
    a term counts inside longer words too, and k notes a task and Arrow batch
    leave their task."""
    asked = tasks.select(F.col("task_id").alias("query_id"), T.task_terms(F.col("text")).alias("own"))
    size = F.aggregate(F.coalesce("own", F.array().cast("array<string>")), F.lit(16).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    full = F.concat("text", F.lit(" "), F.regexp_extract("path", r"([^/]*?)(\.md)?$", 1))
    n = notes.filter(F.col("path") != rules).select("path", F.lower(full).alias("low"), "text")
    scored = batch.over(asked, size, n, lambda it, table: _counted(it, table, k), f"task_id {tasks.schema['task_id'].dataType.simpleString()}, score long, path string, text string")
    first = notes.filter(F.col("path") == rules).select(F.lit(1 << 62).alias("score"), "path", F.concat(F.lit(f"Source: {rules}\n"), T.excerpt(F.col("text"), 3600)).alias("block"))
    rest = scored.select("task_id", "score", "path", F.concat(F.lit("Source: "), "path", F.lit("\n"), T.excerpt(F.col("text"), 2400)).alias("block"))
    ruled = tasks.select("task_id", F.lit(rules).alias("path")).join(first, "path").select("task_id", "score", "path", "block")
    return top_k(ruled.unionByName(rest), ["task_id"], [F.desc("score"), F.asc("path")], k).select("task_id", "pos", "path", "block")
