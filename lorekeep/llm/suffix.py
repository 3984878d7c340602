"""Suffix dedup by a sparse suffix array.

Suffixes are kept at content-selected places only: minimisers, the place of
the least hash among each ``length - 7`` consecutive runs of eight words.  Each
window of ``length`` words has one (the first of equals), so a passage keeps the
same suffixes in all its copies, and a suffix stands for a run of windows.

1. Eight-word starts of suffixes that occur twice anywhere are found; only
   their suffixes go on, with the words that their windows reach to the right
   and to the left.
2. Suffixes are sorted by their words and compared with their neighbours.
   Neighbours with all words in common repeat each other's windows whole.  Of
   others that start alike, the words in common to the right and to the left
   are extended: a window repeats if both together fill it.  A window's words
   are compared, not only hashed.
3. Windows that overlap on the same line join to passages.

Hot suffixes.  Suffixes of a task's batch with all words in common meet there,
and only the first goes on.  Starts that more than 1 in 1,000 suffixes have (so
fewer than 1,000) would still fill a task.  Their suffixes are sorted by a hash
of all their words, so that those with all words in common meet; of what is
left the windows are dealt out one by one, by a hash of the whole window.  So
are those of any other run of more than LONG_RUN different suffixes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .base import HOT, batches_of, discard, stored
from .repeats import keyed, mixed, removal, window_hashes

LENGTH, GRAM = 50, 8
#: Suffixes that start alike are compared side by side up to so many; more are dealt out by window.
LONG_RUN = 8192
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def minimisers(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the least gram (the first of equals) among each ``width``
    consecutive ones, with the first and last window start that each stands for."""
    if len(grams) < width:
        return (np.empty(0, np.int64),) * 3
    out = []
    for a in range(0, len(grams) - width + 1, 50_000):
        part = grams[a : a + 50_000 + width - 1]
        out.append(sliding_window_view(part, width).argmin(axis=1) + np.arange(a, a + len(part) - width + 1))
    low = np.concatenate(out)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    return low[first], first, np.append(first[1:], len(low)) - 1


class Suffixes:
    """Suffixes as columns: ``k`` (hash of the start, or of all words if ``hot``), ``row``,
    ``pos``; the places ``low``..``high`` before pos where their windows start; ``words``: hashes of
    the words from pos on, then of those before it, the nearest first, 0 where no window reaches."""

    NAMES = ("k", "row", "pos", "low", "high", "hot", "words")

    def __init__(self, k, row, pos, low, high, hot, words) -> None:
        self.k, self.row, self.pos, self.low, self.high, self.hot, self.words = k, row, pos, low, high, hot, words

    def __len__(self) -> int:
        return len(self.k)

    def take(self, at) -> Suffixes:
        return Suffixes(*(getattr(self, c)[at] for c in self.NAMES))

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(p, c) for p in parts]) for c in Suffixes.NAMES))


def suffixes_of(row: int, h: np.ndarray, marks: np.ndarray, length: int) -> Suffixes:
    """The suffixes at marked minimisers of a text given by its words' hashes."""
    grams = window_hashes(h, GRAM)
    place, first, last = minimisers(grams, length - GRAM + 1)
    on = np.isin(place, marks)
    place, first, last = place[on], first[on], last[on]
    reach = np.concatenate([np.arange(length), -np.arange(1, length - GRAM + 1)])
    at = place[:, None] + reach
    held = (at >= first[:, None]) & (at < last[:, None] + length)
    short = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    words = np.where(held, short[np.clip(at, 0, len(h) - 1)], np.uint32(0))
    none = np.zeros(len(place), np.int64)
    return Suffixes(grams[place], np.full(len(place), row, np.int64), place, place - last, place - first, none, words)


def hits(row, pos, n, src_row, src_pos) -> list[np.ndarray]:
    """Windows found (n places from pos on): columns k, k2, row, pos, n, src_row, src_pos."""
    zero = np.zeros(len(row), np.int64)
    return [zero, zero, *(np.asarray(x, np.int64) for x in (row, pos, n, src_row, src_pos))]


def whole(s: Suffixes, order: np.ndarray, same: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Suffixes with all words in common with the one before them (``same``,
    in ``order``) repeat the first of these, if that is in another row: windows
    found, and the suffixes that are left."""
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    known = same & (s.row[order] != s.row[head])
    mine, first = order[known], head[known]
    high, low = s.high[mine], s.low[mine]
    return hits(s.row[mine], s.pos[mine] - high, high - low + 1, s.row[first], s.pos[first] - high), order[~known]


def extended(s: Suffixes, length: int) -> list[np.ndarray]:
    """Windows of suffixes that start alike, by the words that they have in common to the right and to the left."""
    n = s.high - s.low + 1
    i = np.repeat(np.arange(len(s)), n)
    left = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + s.low[i]  # words of the window before the suffix
    # hashes of the first words to the right and to the left, by their number
    sums = np.zeros((len(s), s.words.shape[1] + 1), np.uint64)
    for j in range(s.words.shape[1]):
        sums[:, j + 1] = mixed(sums[:, j] * _ONE + s.words[:, j]) if j != length else mixed(s.words[:, j].astype(np.uint64) + _TWO)
    back = np.where(left > 0, sums[i, length + left], np.uint64(0))
    key = mixed(mixed(s.k[i] ^ sums[i, length - left]) + back * _TWO + left.astype(np.uint64))
    order = np.lexsort((s.pos[i] - left, s.row[i], key))
    i, left, key = i[order], left[order], key[order]
    head = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1])[: len(key)], np.arange(len(key)), 0)) if len(key) else order
    known = s.row[i] != s.row[i[head]]
    i, left, first = i[known], left[known], i[head][known]
    # the words themselves: those of the window, to the right and to the left
    column = np.arange(s.words.shape[1])
    real = np.empty(len(i), bool)
    for a in range(0, len(i), 50_000):
        b = slice(a, a + 50_000)
        inside = np.where(column < length, column < length - left[b, None], column < length + left[b, None])
        real[b] = ((s.words[i[b]] == s.words[first[b]]) | ~inside).all(axis=1) & (s.k[i[b]] == s.k[first[b]])
    i, left, first = i[real], left[real], first[real]
    # neighbouring windows with neighbouring partners are one row
    row, pos, src_row, src_pos = s.row[i], s.pos[i] - left, s.row[first], s.pos[first] - left
    order = np.lexsort((pos, row))
    row, pos, src_row, src_pos = row[order], pos[order], src_row[order], src_pos[order]
    cut = (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1) | (src_row[1:] != src_row[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)
    start = np.flatnonzero(np.append(True, cut)[: len(row)])
    return hits(row[start], pos[start], np.diff(np.append(start, len(row))), src_row[start], src_pos[start])


def dealt_out(s: Suffixes, length: int) -> list[np.ndarray]:
    """All windows of suffixes, each to be compared by hashes of the whole: n is 0."""
    n = s.high - s.low + 1
    i = np.repeat(np.arange(len(s)), n)
    left = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + s.low[i]
    key, key2 = np.full(len(i), _ONE), np.full(len(i), _TWO)
    column = np.arange(s.words.shape[1])
    for a in range(0, len(i), 50_000):
        b = slice(a, a + 50_000)
        inside = np.where(column < length, column < length - left[b, None], column < length + left[b, None])
        words = np.where(inside, s.words[i[b]], np.uint32(0)).astype(np.uint64)
        for j in range(words.shape[1]):
            key[b], key2[b] = mixed(key[b] * _ONE + words[:, j]), mixed(key2[b] * _TWO + words[:, j])
    key, key2 = mixed(key + left.astype(np.uint64)), key2 >> np.uint64(33)
    zero = np.zeros(len(i), np.int64)
    return [key.view(np.int64), key2.astype(np.int64), s.row[i], s.pos[i] - left, zero, zero, zero]


SORTED = pa.schema([("k", pa.int64()), ("words", pa.binary()), ("row", pa.int64()), ("pos", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("hot", pa.int64()), ("src_row", pa.int64()), ("src_pos", pa.int64())])
FOUND = pa.schema([(c, pa.int64()) for c in ("k", "k2", "row", "pos", "n", "src_row", "src_pos")])


def _batch(cols: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _ordered(held: list, length: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The suffixes of a batch of texts, less those that another one of the batch decides
    (these pass by as windows found: no words, ``high`` their number)."""
    parts = [suffixes_of(row, h, marks, length) for row, h, marks in held]
    s = Suffixes.joined(parts)
    if not len(s):
        return
    weights = mixed(np.arange(1, s.words.shape[1] + 1, dtype=np.uint64) * _ONE)
    digest = np.zeros(len(s), np.uint64)
    for j, weight in enumerate(weights):
        digest += s.words[:, j] * weight
    order = np.lexsort((s.pos, s.row, digest, s.k))
    same = np.append(False, (s.k[order[1:]] == s.k[order[:-1]]) & (s.words[order[1:]] == s.words[order[:-1]]).all(axis=1))
    (_, _, row, pos, n, src_row, src_pos), left = whole(s, order, same)
    if len(row):
        route = mixed(row.view(np.uint64) * _ONE + pos.astype(np.uint64)).view(np.int64)
        none = pa.array([b""] * len(row), pa.binary())
        zero = np.zeros(len(row), np.int64)
        yield _batch([route, none, row, pos, zero, n, zero, src_row, src_pos], SORTED)
    s, digest = s.take(left), digest[left]
    s.hot = np.isin(s.k, often).astype(np.int64)
    s.k = np.where(s.hot > 0, mixed(s.k ^ digest), s.k)
    for a in range(0, len(s), 20_000):
        t = s.take(slice(a, a + 20_000))
        raw = t.words.astype(">u4").tobytes()
        size = 4 * t.words.shape[1]
        words = pa.array([raw[j : j + size] for j in range(0, len(raw), size)], pa.binary())
        zero = np.zeros(len(t), np.int64)
        yield _batch([t.k.view(np.int64), words, t.row, t.pos, t.low, t.high, t.hot, zero, zero], SORTED)


def _texts(source: Iterator[pa.RecordBatch], length: int, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Gathers texts (row, text, marks) up to BATCH_WORDS words and yields their suffixes."""
    held, words = [], 0
    for b in source:
        for row, text, marks in zip(b.column("row").to_pylist(), b.column("text"), b.column("marks"), strict=True):
            h = repeats.word_hashes(text.as_py())
            held.append((row, h, marks.values.to_numpy(zero_copy_only=False)))
            words += len(h)
            if words >= repeats.BATCH_WORDS:
                yield from _ordered(held, length, often)
                held, words = [], 0
    if held:
        yield from _ordered(held, length, often)


def _compared(source: Iterator[pa.RecordBatch], length: int, long_run: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes -> windows found, and windows of long runs to be dealt out (n = 0).

    Memory: a batch and one run of up to ``long_run`` different suffixes."""
    wait: Suffixes | None = None
    dealt: np.uint64 | None = None  # the run that is being dealt out
    for b in itertools.chain(source, [None]):
        parts = [] if wait is None else [wait]
        if b is not None:
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "words"}
            raw = b.column("words")
            sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1])
            passed = np.flatnonzero(sizes == 0)
            if len(passed):
                yield _batch(hits(*(cols[c][passed] for c in ("row", "pos", "high", "src_row", "src_pos"))), FOUND)
            on = np.flatnonzero(sizes)
            if len(on):
                words = np.frombuffer(b"".join(raw.take(pa.array(on)).to_pylist()), ">u4").reshape(len(on), -1).astype(np.uint32)
                parts.append(Suffixes(cols["k"][on].view(np.uint64), *(cols[c][on] for c in ("row", "pos", "low", "high", "hot")), words))
        if not parts:
            continue
        s = Suffixes.joined(parts)
        same = np.append(False, (s.k[1:] == s.k[:-1]) & (s.words[1:] == s.words[:-1]).all(axis=1))
        found, left = whole(s, np.arange(len(s)), same)
        if len(found[0]):
            yield _batch(found, FOUND)
        s = s.take(left)
        ready = len(s) if b is None else int(np.flatnonzero(np.append(True, s.k[1:] != s.k[:-1]))[-1])
        if dealt is not None and ready:
            more = s.k[:ready] == dealt
            if more.any():
                yield _batch(dealt_out(s.take(np.flatnonzero(more)), length), FOUND)
            done = s.take(np.flatnonzero(~more))
            dealt = None
        else:
            done = s.take(slice(0, ready))
        wait = s.take(slice(ready, len(s)))
        if len(wait) > long_run or dealt is not None and len(wait):
            dealt = wait.k[0]
            for a in range(0, len(wait), 4096):
                yield _batch(dealt_out(wait.take(slice(a, a + 4096)), length), FOUND)
            wait = None
        for a in range(0, len(loose := np.flatnonzero(done.hot)), 4096):
            yield _batch(dealt_out(done.take(loose[a : a + 4096]), length), FOUND)
        rest = done.take(np.flatnonzero(done.hot == 0))
        if not len(rest):
            continue
        alike = rest.k[1:] == rest.k[:-1]
        rest = rest.take(np.flatnonzero(np.append(False, alike) | np.append(alike, False)))
        for part in _runs(rest, long_run):
            if len(found := extended(part, length))and len(found[0]):
                yield _batch(found, FOUND)


def _runs(s: Suffixes, about: int) -> Iterator[Suffixes]:
    """Whole runs of suffixes that start alike, about so many suffixes at once."""
    starts = np.append(np.flatnonzero(np.append(True, s.k[1:] != s.k[:-1])[: len(s)]), len(s))
    a = 0
    while a < len(s):
        b = int(starts[np.searchsorted(starts, min(a + about, len(s)))])
        yield s.take(slice(a, b))
        a = b


def sparse(rows: DataFrame, length: int, long_run: int = LONG_RUN, hot: float = HOT) -> DataFrame:
    """Windows of ``length`` words of rows (row, id, text) that also stand in a row before theirs.

    Returns a stored table: ``row``, ``pos`` (first of ``n`` places in a row),
    ``n``, ``src_row``, ``src_pos`` (the first one's earlier place)."""
    spark, width = rows.sparkSession, length - GRAM + 1
    starts = repeats.anchors(rows, GRAM, lambda h, grams: minimisers(grams, width)[0])
    with batches_of(spark, 512):
        starts = stored(starts, "starts")
    total = starts.agg(F.sum("c")).first()[0] or 0
    often = starts.groupBy("k").agg(F.sum("c").alias("n")).filter(F.col("n") > total * hot).select("k").collect()  # fewer than 1 / hot
    often = np.array([r["k"] for r in often], np.int64).view(np.uint64)
    marks = repeats.repeated_anchors(starts).groupBy(F.col("row").alias("r")).agg(F.collect_list(F.col("pos").cast("int")).alias("marks"))
    marks = stored(marks, "marks")  # a stage of its own: Python workers of one step at a time
    near = rows.select("row", "text").join(marks, F.col("row") == F.col("r")).select("row", "text", "marks")

    kinds = "k long, words binary, row long, pos long, low long, high long, hot long, src_row long, src_pos long"
    suffixes = near.mapInArrow(lambda it: _texts(it, length, often), kinds)
    order = suffixes.repartition("k").sortWithinPartitions("k", "words", "row", "pos")
    found = order.mapInArrow(lambda it: _compared(it, length, long_run), "k long, k2 long, row long, pos long, n long, src_row long, src_pos long")
    with batches_of(spark, 512):
        found = stored(found, "suffixes")
    cols = ["row", "pos", "n", "src_row", "src_pos"]
    loose = found.filter("n = 0").select("k", "k2", "row", (F.shiftleft("pos", 32) + 4).alias("at"), "src_row", "src_pos")
    rest = stored(repeats.earlier(loose, across=True), "windows")
    discard(starts, marks)
    return found.filter("n > 0").select(*cols).unionByName(rest.select(*cols))


def _passages(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Joins windows that overlap on the same line (same earlier row, same
    distance) to passages; one inside another passage of its row is left out.
    Rows come sorted; what may go on in the next batch waits for it."""
    names = ["row", "src_row", "pos", "src_pos", "n"]
    held: list[np.ndarray] | None = None
    for b in itertools.chain(batches, [None]):
        cols = None if b is None else [b.column(c).to_numpy() for c in names]
        if held is not None:
            cols = held if cols is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if cols is None or not len(cols[0]):
            continue
        ready = len(cols[0]) if b is None else int(np.searchsorted(cols[0], cols[0][-1]))
        held = [c[ready:] for c in cols]
        if not ready:
            continue
        row, src, pos, src_pos, n = (c[:ready] for c in cols)
        end, line = pos + n - 1 + length, pos - src_pos
        cut = (row[1:] != row[:-1]) | (src[1:] != src[:-1]) | (line[1:] != line[:-1]) | (pos[1:] > end[:-1])
        first = np.flatnonzero(np.append(True, cut))
        row, pos, src, src_pos, end = row[first], pos[first], src[first], src_pos[first], np.maximum.reduceat(end, first)
        order = np.lexsort((src, -end, pos, row))
        row, pos, src, src_pos, end = row[order], pos[order], src[order], src_pos[order], end[order]
        own = np.cumsum(np.append(True, row[1:] != row[:-1])) * (1 << 40) + end
        keep = np.append(True, own[1:] > np.maximum.accumulate(own)[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (row, src, pos, end - pos, src_pos)], names=["row", "src_row", "start", "n_words", "earlier_start"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **params) -> DataFrame:
    """A row for each passage of at least ``length`` words that also stands in
    a row with a smaller id: id, ``start``, ``n_words``, ``earlier_id``,
    ``earlier_start`` (places in words).

    Together the passages of a row cover every word that is in any such
    window; each names one earlier place.  Repeats inside one row alone don't
    count.  Null texts have no words; null ids sort last; rows that repeat an
    id are told apart.  Texts shorter than ``length``: none; long ones count
    whole.  Other columns are not read, whatever their names.  Empty table:
    no rows.
    """
    rows, numbered = keyed(docs, id_col, text_col)
    found = sparse(rows, length, **params)
    lines = found.repartition("row").sortWithinPartitions("row", "src_row", F.col("pos") - F.col("src_pos"), "pos")
    spans = lines.select("row", "src_row", "pos", "src_pos", "n").mapInArrow(lambda it: _passages(it, length), "row long, src_row long, start long, n_words long, earlier_start long")
    ids = rows.select("row", "id")
    mine, theirs = ids.select(F.col("row").alias("r1"), F.col("id").alias(id_col)), ids.select(F.col("row").alias("r2"), F.col("id").alias("earlier_id"))
    if not numbered:
        return spans.select(F.col("row").alias(id_col), "start", "n_words", F.col("src_row").alias("earlier_id"), "earlier_start")
    spans = spans.join(mine, F.col("row") == F.col("r1")).join(theirs, F.col("src_row") == F.col("r2"))
    return spans.select(id_col, "start", "n_words", "earlier_id", "earlier_start")


def without_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **params) -> DataFrame:
    """One row for each row of docs: id, ``n_words``, ``n_removed``, ``kept_sha256``,
    ``kept_text`` (words outside all passages that also stand in an earlier row)."""
    rows, _ = keyed(docs, id_col, text_col)
    found = sparse(rows, length, **params)
    return removal(rows, found, length, id_col, keep_text=True)
