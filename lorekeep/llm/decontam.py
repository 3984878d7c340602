"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A region of a document within k edits of an item of m characters shares at
least m - q + 1 - k*q q-grams with it, all on diagonals at most k apart.
Shared q-grams are counted in overlapping diagonal bands; bands that meet the
bound are verified by a banded alignment.  Items of fewer than q characters
have no q-gram; they are looked for as whole words, without edits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches_of, by_size, stored

Q = 8
#: Edits allowed for each character of an item.
RATE = 0.1
#: Items are indexed and broadcast in blocks of at most so many characters.
BLOCK_CHARS = 4_000_000
#: Postings of a batch's q-grams that are in memory at once.
MOST_POSTINGS = 4_000_000
NOT_WORD = re.compile(r"[\W_]+")
_SLOTS = 22
#: First and last characters of scripts that put no spaces between words (Thai to Tibetan, Myanmar, Khmer, kana, Han).
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def normal(text: str | None) -> str:
    """Case folded; each run of other than letters and digits is one space."""
    return NOT_WORD.sub(" ", (text or "").casefold()).strip()


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _folded(chars: np.ndarray) -> np.ndarray:
    """One byte a character, so that eight characters are one integer; alignment uses the characters."""
    return np.where(chars < 128, chars, 128 + (chars & 127)).astype(np.uint8)


def grams(folded: np.ndarray) -> np.ndarray:
    """All q-grams (q = 8) as integers, one a position."""
    if len(folded) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(folded) - Q + 1,), dtype="<u8", buffer=np.ascontiguousarray(folded), strides=(1,)).copy()


def _words(chars: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` characters."""
    out = np.zeros(max(0, len(chars) - size + 1), np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + chars[i : i + len(out)]
    return out


def _unspaced(chars: np.ndarray) -> np.ndarray:
    return np.any([(chars >= a) & (chars <= b) for a, b in UNSPACED], axis=0)


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


@dataclass
class QGramIndex:
    ids: list
    items: list[np.ndarray]
    budget: np.ndarray  # edits an item
    need: np.ndarray  # q-grams a band
    codes: np.ndarray  # distinct q-grams, sorted
    starts: np.ndarray  # of each one's postings
    at_item: np.ndarray
    at_pos: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # size under q -> hashes, sorted, and their items

    @classmethod
    def build(cls, rows: list[tuple[int, str]], rate: float = RATE) -> QGramIndex:
        rows = [(i, _chars(t)) for i, t in rows]
        rows = [(i, t) for i, t in rows if len(t)]
        sizes = np.array([len(t) for _, t in rows], np.int64)
        budget = np.minimum((sizes * rate).astype(np.int64), np.maximum(0, (sizes - Q) // Q))
        codes = [grams(_folded(t)) for _, t in rows]
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(rows)), [len(c) for c in codes])
        pos = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        short = {}
        for size in sorted(set(sizes[sizes < Q].tolist())):
            of = np.flatnonzero(sizes == size)
            hashes = np.concatenate([_words(rows[x][1], size) for x in of])
            by = np.argsort(hashes, kind="stable")
            short[size] = hashes[by], of[by]
        order = np.argsort(flat, kind="stable")
        own, starts = np.unique(flat[order], return_index=True)
        return cls([i for i, _ in rows], [t for _, t in rows], budget, sizes - Q + 1 - budget * Q, own, np.append(starts, len(flat)), item[order], pos[order], short)

    def ranges(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """For each q-gram where its postings of the items first..stop-1 are."""
        if first == 0 and stop >= len(self.items):
            return self.starts[:-1], self.starts[1:]
        # postings are sorted by q-gram, then item: as one key
        gram = np.repeat(np.arange(len(self.codes)), np.diff(self.starts)) * len(self.items) + self.at_item
        own = np.arange(len(self.codes)) * len(self.items)
        return np.searchsorted(gram, own + first), np.searchsorted(gram, own + min(stop, len(self.items)))

    def table(self) -> np.ndarray:
        t = np.zeros(1 << _SLOTS, bool)
        t[_slot(self.codes)] = True
        return t


def band_distances(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair the least edits between item and any region of text whose
    alignment stays on diagonals low..high (text place minus item place);
    most + 1 if above most.  Pairs are aligned side by side, a row of all
    their tables at a time, the longest item first."""
    out = most + 1
    left = np.argsort([-len(x) for x in items], kind="stable")
    for a in range(0, len(left), 256):
        pick = left[a : a + 256]
        sizes = np.array([len(items[c]) for c in pick])
        n = np.array([len(texts[c]) for c in pick])
        width, m = int((high[pick] - low[pick]).max()) + 1, int(sizes[0])
        item, text = np.full((len(pick), m), 0xFFFFFFFF, np.uint32), np.full((len(pick), m + width), 0xFFFFFFFE, np.uint32)
        for r, c in enumerate(pick):
            item[r, : sizes[r]] = items[c]
            start, stop = max(0, int(low[c])), min(len(texts[c]), int(low[c]) + m + width)
            if start < stop:
                text[r, start - low[c] : stop - low[c]] = texts[c][start:stop]
        place = low[pick][:, None] + np.arange(m + width + 1)
        on = (place >= 0) & (place <= n[:, None])  # places before, between and after the text's characters
        ramp, big = np.arange(width, dtype=np.int32), np.int32(1 << 20)
        row = np.where(on[:, :width], np.int32(0), big)
        row[np.arange(width) > (high - low)[pick][:, None]] = big
        beyond = np.arange(width) > (high - low)[pick][:, None]
        alive = np.arange(len(pick))
        for i in range(m):
            step = row + (text[alive, i : i + width] != item[alive, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)  # an item character without partner
            step[~on[alive, i + 1 : i + 1 + width] | beyond[alive]] = big
            row = np.minimum(np.minimum.accumulate(step - ramp, axis=1) + ramp, big)  # text characters without partner
            row[~on[alive, i + 1 : i + 1 + width] | beyond[alive]] = big
            ended = sizes[alive] == i + 1
            if ended.any() or i % 16 == 15:
                least = row.min(axis=1)
                c = pick[alive[ended]]
                out[c] = np.minimum(out[c], least[ended])
                on_ = ~ended & (least <= most[pick[alive]])
                alive, row = alive[on_], row[on_]
                if not len(alive):
                    break
    return out


def search_short(index: QGramIndex, joined: np.ndarray, begin: np.ndarray, found: list[dict[int, int]]) -> None:
    """Adds the items of fewer than q characters that stand in a text as whole
    words; next to characters of scripts without spaces any place will do."""
    ends = np.concatenate([[0], joined, [0]]).astype(np.uint32)  # 0 stands between texts
    free = (ends == 0) | (ends == 32) | _unspaced(ends)
    for size, (hashes, of) in index.short.items():
        codes = _words(joined, size)
        first, last = np.arange(len(codes)) + 1, np.arange(len(codes)) + size
        whole = np.flatnonzero((free[first - 1] | free[first]) & (free[last] | free[last + 1]))
        a, b = np.searchsorted(hashes, codes[whole]), np.searchsorted(hashes, codes[whole], "right")
        hits, a, n = whole[b > a], a[b > a], (b - a)[b > a]
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hits, item = np.repeat(hits, n), of[at]
        real = (joined[hits[:, None] + np.arange(size)] == np.stack([index.items[x] for x in of])[at]).all(axis=1)
        hits, item = hits[real], item[real]
        doc = np.searchsorted(begin, hits, "right") - 1
        for d, i in zip(*divmod(np.unique(doc * len(index.items) + item), len(index.items)), strict=True):
            found[d][int(i)] = 0


def search(index: QGramIndex, table: np.ndarray, texts: list[str | None]) -> list[list[tuple]]:
    """For each text the items found: (item id, edits)."""
    found: list[dict[int, int]] = [{} for _ in texts]
    if not index.items or not texts:
        return [[] for _ in texts]
    chars = [_chars(normal(t)) for t in texts]
    gap = np.zeros(Q, np.uint32)
    joined = np.concatenate([x for c in chars for x in (c, gap)])
    begin = np.concatenate([[0], np.cumsum([len(c) + Q for c in chars])])
    if index.short:
        search_short(index, joined, begin, found)
    if len(index.codes):
        search_long(index, table, texts, chars, joined, begin, found)
    return [sorted(((index.ids[i], e) for i, e in f.items()), key=lambda x: (x[0] is None, x[0] or 0, x[1])) for f in found]


def search_long(index: QGramIndex, table: np.ndarray, texts: list[str | None], chars: list[np.ndarray], joined: np.ndarray, begin: np.ndarray, found: list[dict[int, int]]) -> None:
    """Adds the items of q characters or more, with the edits found."""
    codes = grams(_folded(joined))
    hits = np.flatnonzero(table[_slot(codes)])
    at = np.minimum(np.searchsorted(index.codes, codes[hits]), len(index.codes) - 1)
    real = index.codes[at] == codes[hits]
    hits, at = hits[real], at[real]
    n = index.starts[at + 1] - index.starts[at]
    if n.sum() > MOST_POSTINGS and len(texts) > 1:
        # q-grams that many items share: fewer texts at once
        half = len(texts) // 2
        cut = int(begin[half])
        search_long(index, table, texts[:half], chars[:half], joined[:cut], begin[: half + 1], found[:half])
        search_long(index, table, texts[half:], chars[half:], joined[cut:], begin[half:] - cut, found[half:])
        return
    parts = max(1, -(-int(n.sum()) // MOST_POSTINGS))
    width = -(-len(index.items) // parts)
    for first in range(0, len(index.items), width):
        # one text meets so many: fewer items at once (a q-gram's postings are in order of the items)
        _search_items(index, first, first + width, hits, at, texts, chars, begin, found)


def _search_items(index: QGramIndex, first: int, stop: int, hits: np.ndarray, at: np.ndarray, texts: list[str | None], chars: list[np.ndarray], begin: np.ndarray, found: list[dict[int, int]]) -> None:
    """Adds the items first..stop-1, from the places and numbers of the q-grams hit."""
    starts, ends = index.ranges(first, stop)
    starts, n = starts[at], ends[at] - starts[at]
    post = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    item, diag = index.at_item[post], np.repeat(hits, n) - index.at_pos[post]
    k = index.budget[item]
    step = np.maximum(k, 16)  # a band is step + k wide and starts every step: any k-wide range is inside one
    band = diag // step
    low = diag - band * step < k
    place = index.at_pos[post]
    keys = np.concatenate([item * (1 << 40) + band + (1 << 20), item[low] * (1 << 40) + band[low] - 1 + (1 << 20)])
    place = np.concatenate([place, place[low]])
    full, count = np.unique(keys, return_counts=True)
    full = full[count >= index.need[full >> 40]]
    near = np.minimum(np.searchsorted(full, keys), max(0, len(full) - 1))
    inside = full[near] == keys if len(full) else np.zeros(len(keys), bool)
    # the bound is on places of the item: one that is hit twice counts once
    keys, place = keys[inside], place[inside]
    order = np.lexsort((place, keys))
    keys, place = keys[order], place[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (place[1:] != place[:-1]))[: len(keys)]
    keys, count = np.unique(keys[new], return_counts=True)
    pairs = []
    for key in keys[count >= index.need[keys >> 40]].tolist():
        i, b = key >> 40, (key & ((1 << 40) - 1)) - (1 << 20)
        k = int(index.budget[i])
        step = max(k, 16)
        lo, hi = b * step, b * step + step + k
        # the band may touch several documents where these are short
        for d in range(max(0, int(np.searchsorted(begin, lo, "right")) - 1), len(texts)):
            if begin[d] > hi:
                break
            if begin[d] + len(chars[d]) >= lo:
                pairs.append((d, i, lo - int(begin[d]), hi - int(begin[d]), k))
    if pairs:
        d, i, lo, hi, k = (np.array(x) for x in zip(*pairs, strict=True))
        edits = band_distances([index.items[x] for x in i], [chars[x] for x in d], lo, hi, k)
        for x in np.flatnonzero(edits <= k):
            f = found[d[x]]
            f[i[x]] = min(int(edits[x]), f.get(i[x], int(k[x])))


def _looker(shared: Broadcast):
    @F.pandas_udf("array<struct<item_id:long,edits:int>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value.table()
        for s in batches:
            texts = s.tolist()
            found = [f for a, b in by_size(texts) for f in search(shared.value, table, texts[a:b])]
            yield pd.Series([[{"item_id": i, "edits": e} for i, e in f] for f in found], dtype=object)

    return look


def lookers(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[Callable[[Column], Column], bool]]:
    """Column functions, text -> array of (item_id, edits), and whether they are
    the last one, which together look for all items that have a letter or digit, whatever their length; a null
    id stays null.

    The benchmark is a query set.  Its characters are summed first; blocks of
    about ``block_chars`` are collected, indexed and broadcast.  A block's
    broadcast is destroyed before the next one is made, so what is searched
    with a function must be stored by then.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(benchmark[id_col].cast("long").alias("i"), benchmark[text_col].alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    for b in range(blocks):
        rows = [(r["i"], normal(r["t"])) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toLocalIterator()]
        shared = spark.sparkContext.broadcast(QGramIndex.build(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1])), rate))
        last = b == blocks - 1
        yield _looker(shared), last
        if not last:
            shared.destroy()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that it contains: id, ``item_id``, ``edits``.

    An item is contained if a region of the text is within ``rate`` edits a
    character of it, both normalised (case, and runs of other than letters
    and digits); items of under 8 characters must stand as whole words.
    Null and empty texts or items contain and name nothing; an item with null
    id is reported with a null ``item_id``.  Items that repeat text or id are all reported.  Repeated rows are searched
    each; texts of any length are searched whole; other columns are not read,
    whatever their names; an empty table on either side gives no rows.  No
    shuffle; a benchmark of several blocks takes a pass over the texts each.
    """
    out = None
    for look, _ in lookers(benchmark, rate=rate, block_chars=block_chars):
        found = docs.select(docs[id_col].alias(id_col), F.explode(look(docs[text_col])).alias("f"))
        with batches_of(docs.sparkSession, 256):
            found = stored(found.select(id_col, "f.item_id", "f.edits"), "items")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that contain no item, those with null id included;
    columns as they are, whatever their names.

    As in ``contamination``, a null or empty text contains nothing and stays.
    With several blocks, what one leaves is stored and searched for the next."""
    for look, last in lookers(benchmark, rate=rate, block_chars=block_chars):
        clean = docs.filter(F.size(look(docs[text_col])) == 0)
        docs = clean if last else stored(clean, "clean")
    return docs
