"""Repeated word windows: the machinery under substring dedup, some of it under suffix dedup.

Windows of ``length`` words that occur more than once are looked for.  Hashing
all windows would move every word of the corpus several times over, so

1. anchors (short word runs at selected positions) are hashed, and those that
   occur twice anywhere are kept (``select`` says which positions; any two
   equal windows must share an anchor at the same place);
2. only windows around kept anchors are hashed whole, sorted, and compared
   with their neighbours.

Hot passages.  Each task first compares what it has itself (one batch of
documents): of equal hashes only one goes on to the comparison over all tasks,
the others are decided there and then and pass by, dealt out at random.  A
passage in a third of all documents so makes one row a batch of BATCH_WORDS
words: slim rows that a task sorts as a stream, some ten million of them in
100 TB of text.

Equality.  Windows are equal if 64 bits of a hash over their words' hashes and
31 bits of another, over hashes of the words by another seed, are: 95 bits
that do not depend on each other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batches_of, discard, stored

#: Words that a task compares by itself at once (some 200 MB of arrays).
BATCH_WORDS = 1_500_000
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PASS = 2  # decided already; passes by


class WordHashes(dict):
    """Word -> 64-bit hash, remembered; forgets all when it has grown."""

    def __init__(self, seed: int) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


_HASHES, _MORE = WordHashes(5), WordHashes(6)


def word_hashes(text: str | None, known: WordHashes = _HASHES) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D only
    return np.fromiter(map(known.__getitem__, words), np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POWERS.get(int(base))
    if got is None or len(got[0]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        got = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, inverse))
        _POWERS[int(base)] = got
    return got


def window_hashes(h: np.ndarray, length: int, base: np.uint64 = _B1) -> np.ndarray:
    """A hash of each run of ``length`` words (polynomial, by prefix sums)."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    up, down = _powers(base, len(h) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    n = len(h) - length + 1
    return mixed((sums[length:] - sums[:n]) * down[:n])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(row, id, text), and whether rows have numbers of their own.  ``row`` is
    unique and sorts as the ids do, null last: the id itself where ids are
    whole numbers and unique, else a number given by a sort."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    whole = rows.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole:
        n = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        if not n.filter("id is null or n > 1").limit(1).count():
            return rows.select(F.col("id").cast("long").alias("row"), "id", "text"), False
    ordered = rows.orderBy(F.col("id").isNull(), "id", F.xxhash64("text"))
    return stored(ordered.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "keyed"), True


def _batches(source: Iterator[pa.RecordBatch], work: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Gathers documents (word hashes, row, marks) up to BATCH_WORDS and yields what work makes of them."""
    held, words = [], 0

    def made() -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[0])
        cols = work(held)
        for a in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000], t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
        held.clear()

    for b in source:
        marks = b.column("marks") if "marks" in b.schema.names else None
        for i, (row, text) in enumerate(zip(b.column("row").to_pylist(), b.column("text"), strict=True)):
            h = word_hashes(text.as_py())
            if len(h):
                # windows are compared by hashes of both kinds
                more = None if marks is None else (marks[i].values.to_numpy(zero_copy_only=False), word_hashes(text.as_py(), _MORE))
                held.append((row, h, more))
                words += len(h)
            if words >= BATCH_WORDS:
                yield from made()
                words = 0
    if held:
        yield from made()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchor_rows(held: list, length: int, select: Callable) -> list[np.ndarray]:
    parts = []
    for row, h, _ in held:
        grams = window_hashes(h, length)
        at = select(h, grams)
        parts.append((grams[at], np.full(len(at), row, np.int64), at))
    k, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(k, kind="stable")
    k, row, pos = k[order], row[order], pos[order]
    same = k[1:] == k[:-1]
    later, twice = np.append(False, same)[: len(k)], np.append(same, False)[: len(k)]
    state = np.where(later, _PASS, twice).astype(np.int64)
    first = np.flatnonzero(~later)
    count = np.zeros(len(k), np.int64)
    count[first] = np.diff(np.append(first, len(k)))
    return [_signed(k), row, (pos.astype(np.int64) << 2) | state, count]


def _window_rows(held: list, length: int, anchor: int, across: bool) -> list[np.ndarray]:
    parts = []
    for row, h, (marks, other) in held:
        n = len(h) - length + 1
        if n <= 0:
            continue
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(0, marks - (length - anchor)), 1)
        np.add.at(edge, np.minimum(n, marks + 1), -1)
        at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
        parts.append((window_hashes(h, length)[at], window_hashes(other, length, _B2)[at], np.full(len(at), row, np.int64), at))
    if not parts:
        return [np.empty(0, np.int64)] * (6 if across else 4)
    k, k2, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    k2 = (k2 >> np.uint64(33)).astype(np.int64)
    order = np.lexsort((k2, k)) if len(k) else np.empty(0, np.int64)  # stable: rows and places stay in order
    k, k2, row, pos = k[order], k2[order], row[order], pos[order]
    new = np.append(True, (k[1:] != k[:-1]) | (k2[1:] != k2[:-1]))[: len(k)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else order
    known = ~new & (row != row[head]) if across else ~new
    out = [_signed(k[~known]), k2[~known], row[~known], (pos[~known].astype(np.int64) << 32) | (1 << 2)]
    src = [np.zeros(len(out[0]), np.int64), np.zeros(len(out[0]), np.int64)]
    # what is decided goes on as runs of places
    r, p, sr, sp = row[known], pos[known], row[head][known], pos[head][known]
    order = np.lexsort((p, r))
    r, p, sr, sp = r[order], p[order], sr[order], sp[order]
    cut = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    if across:
        cut |= (sr[1:] != sr[:-1]) | (sp[1:] != sp[:-1] + 1)
    start = np.flatnonzero(np.append(True, cut)[: len(r)])
    n = np.diff(np.append(start, len(r)))
    r, p = r[start], p[start].astype(np.int64)
    run = [_signed(mixed(r.view(np.uint64) * _B1 + p.astype(np.uint64))), np.zeros(len(r), np.int64), r, (p << 32) | (n << 2) | _PASS]
    cols = [np.concatenate(x) for x in zip(out, run, strict=True)]
    return cols + [np.concatenate(x) for x in zip(src, (sr[start], sp[start].astype(np.int64)), strict=True)] * across


def _runs(source: Iterator[pa.RecordBatch], keys: list[str], finish: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Neighbours compared in sorted rows.  Yields what ``finish`` makes of the
    columns, the columns of each row's run head (run: equal keys), whether a
    row is its run's first, whether its run goes on, and whether it passes by.

    Memory: one batch.  Its last row waits for the next batch, and the head of
    the running run is carried over.
    """
    head: dict | None = None
    wait: dict | None = None
    for b in itertools.chain(source, [None]):
        parts = [x for x in (wait, b and {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}) if x]
        if not parts:
            continue
        t = {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
        n = len(t["row"])
        emit = n - (b is not None)
        wait = {c: v[emit:] for c, v in t.items()}
        skip = (t["at"] & 3) == _PASS
        at = np.flatnonzero(~skip)
        first, more, heads = np.zeros(n, bool), np.zeros(n, bool), {c: v.copy() for c, v in t.items()}
        if len(at):
            new = np.zeros(len(at), bool)
            new[0] = head is None or any(t[c][at[0]] != head[c] for c in keys)
            for c in keys:
                new[1:] |= t[c][at[1:]] != t[c][at[:-1]]
            first[at], more[at[:-1]] = new, ~new[1:]
            run = np.maximum.accumulate(np.where(new, np.arange(len(at)), -1))
            for c, v in t.items():
                heads[c][at] = np.where(run >= 0, v[at][np.maximum(run, 0)], 0 if head is None else head[c])
            if done := at[at < emit].tolist():
                head = {c: heads[c][done[-1]] for c in t}
        cols = finish({c: v[:emit] for c, v in t.items()}, {c: v[:emit] for c, v in heads.items()}, first[:emit], more[:emit], skip[:emit])
        if len(cols[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _dup_anchors(t: dict, heads: dict, first: np.ndarray, more: np.ndarray, skip: np.ndarray) -> list[np.ndarray]:
    """Anchors that occur twice: decided in their batch, or with a neighbour that is equal."""
    twice = skip | ((t["at"] & 3) == 1) | ~first | more
    return [t["k"][twice], t["row"][twice], t["at"][twice] >> 2]


def _earlier(t: dict, heads: dict, first: np.ndarray, more: np.ndarray, skip: np.ndarray) -> list[np.ndarray]:
    """Windows that are not the first of their run, or decided in their batch."""
    known = skip | ~first
    return [t["row"][known], t["at"][known] >> 32, (t["at"][known] & 0xFFFFFFFF) >> 2]


def _earlier_across(t: dict, heads: dict, first: np.ndarray, more: np.ndarray, skip: np.ndarray) -> list[np.ndarray]:
    """Windows whose run starts in another row, with that place."""
    known = skip | (t["row"] != heads["row"])
    row, at, by = t["row"][known], t["at"][known], skip[known]
    src_row, src_pos = np.where(by, t["src_row"][known], heads["row"][known]), np.where(by, t["src_pos"][known], heads["at"][known] >> 32)
    return [row, at >> 32, (at & 0xFFFFFFFF) >> 2, src_row, src_pos]


def anchors(rows: DataFrame, anchor: int, select: Callable) -> DataFrame:
    """Runs of ``anchor`` words at selected places of rows (row, text): ``k`` (hash), ``row``, ``at``
    (place and what its batch knows), ``c`` (how many its batch has, at the first; else 0)."""
    schema = pa.schema([(c, pa.int64()) for c in ("k", "row", "at", "c")])
    return rows.select("row", "text").mapInArrow(lambda it: _batches(it, lambda held: _anchor_rows(held, anchor, select), schema), "k long, row long, at long, c long")


def repeated_anchors(anchors_: DataFrame) -> DataFrame:
    """(k, row, pos) of anchors that occur twice anywhere.  What a batch decided passes by, dealt out at random."""
    route = F.when(F.col("at").bitwiseAND(3) == _PASS, F.xxhash64("row", "at")).otherwise(F.col("k"))
    sorted_ = anchors_.select(route.alias("route"), "k", "row", "at").repartition("route").sortWithinPartitions("route", "row", "at")
    schema = pa.schema([("k", pa.int64()), ("row", pa.int64()), ("pos", pa.int64())])
    return sorted_.mapInArrow(lambda it: _runs(it, ["route"], _dup_anchors, schema), "k long, row long, pos long")


def windows(near: DataFrame, length: int, anchor: int, across: bool) -> DataFrame:
    """Windows around marked anchors of near (row, text, marks), hashed whole; ``earlier`` compares them."""
    names = ["k", "k2", "row", "at"] + ["src_row", "src_pos"] * across
    schema = pa.schema([(c, pa.int64()) for c in names])
    return near.mapInArrow(lambda it: _batches(it, lambda held: _window_rows(held, length, anchor, across), schema), ", ".join(f"{c} long" for c in names))


def earlier(windows_: DataFrame, across: bool) -> DataFrame:
    """Windows (``row``, ``pos``, ``n`` places) that occur earlier; if ``across``, in another row, with that place."""
    sorted_ = windows_.repartition("k").sortWithinPartitions("k", "k2", "row", "at")
    out = ["row", "pos", "n"] + ["src_row", "src_pos"] * across
    schema = pa.schema([(c, pa.int64()) for c in out])
    return sorted_.mapInArrow(lambda it: _runs(it, ["k", "k2"], _earlier_across if across else _earlier, schema), ", ".join(f"{c} long" for c in out))


def repeated(rows: DataFrame, length: int, anchor: int, select: Callable) -> DataFrame:
    """Windows of ``length`` words of rows (row, id, text) that occur earlier, in
    another row or their own: a stored table of ``row``, ``pos`` (first of ``n`` places), ``n``."""
    spark = rows.sparkSession
    marks = repeated_anchors(anchors(rows, anchor, select)).groupBy("row").agg(F.collect_list(F.col("pos").cast("int")).alias("marks"))
    with batches_of(spark, 512):
        marks = stored(marks, "anchors")
    near = rows.select("row", "text").join(marks.withColumnRenamed("row", "r"), F.col("row") == F.col("r")).select("row", "text", "marks")
    with batches_of(spark, 512):
        found = stored(earlier(windows(near, length, anchor, across=False), across=False), "windows")
    discard(marks)
    return found


def covered(n_words: int, length: int, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which words windows starting at pos..pos+n-1 cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, np.minimum(n_words, pos + n - 1 + length), -1)
    return np.cumsum(edge[:n_words]) > 0


def removal(rows: DataFrame, windows: DataFrame, length: int, id_col: str, keep_text: bool) -> DataFrame:
    """Per row: its id, ``n_words``, ``n_removed``, ``kept_sha256``, of the words
    that no window covers, joined by one space; and if asked, that text, ``kept_text``."""
    packed = windows.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.shiftleft("pos", 32) + F.col("n")).alias("marks"))
    both = rows.join(packed, F.col("row") == F.col("r"), "left").select("id", "text", "marks")
    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()][: len(names)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, text in enumerate(b.column("text")):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                kept, m = words, b.column("marks")[i]
                if m.is_valid and len(m.values):
                    v = m.values.to_numpy(zero_copy_only=False)
                    gone = covered(len(words), length, v >> 32, v & 0xFFFFFFFF)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                row = (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest())
                out.append((*row, joined.decode("utf-8", "surrogatepass")) if keep_text else row)
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], names=["id", *names])

    id_type = rows.schema["id"].dataType.simpleString()
    kinds = [f"id {id_type}", "n_words long", "n_removed long", "kept_sha256 string", "kept_text string"][: len(names) + 1]
    made = both.mapInArrow(cut, ", ".join(kinds))
    with batches_of(rows.sparkSession, 512):
        made = stored(made, "kept")
    discard(windows)
    return made.withColumnRenamed("id", id_col)
