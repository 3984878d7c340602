"""Phrase collocations by hashed counting (PCY, with DHP's pruning of the next pass).

Pass m counts the phrases of m words exactly, and in the same reading of the
texts counts the phrases of m + 1 words by hash bucket.  Buckets with fewer
than the least count hold no frequent phrase; so the next pass counts only
phrases whose bucket is full (PCY) and whose first and last m words are
frequent (Apriori), and buckets only what such phrases make up (DHP).  Both
tests are bitmaps of a fixed size that are broadcast.  Bits can be set by
chance, never missing, and what passes is counted exactly: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import batches_of, discard, stored

#: Phrases have 2 to so many words, and occur so often in their language.
LONGEST, LEAST = 4, 30
#: A candidate is dropped if a longer one that holds it has this share (in hundredths) of its count.
SHARE = 80
#: Rows of the report for each language.
REPORT = 2000
#: Buckets are about one for so many characters of text, 2 ** FEWEST to 2 ** MOST of them:
#: a task holds a byte a bucket, and two bitmaps of a bit a bucket are broadcast (8 MB each at most).
CHARS, FEWEST, MOST = 24, 16, 26
#: Bytes of a slice of the bucket counts, the unit that tasks exchange.
SLICE = 1 << 14
#: Texts are cut into words so many bytes at a time (a longer text alone), and counts are
#: put together whenever so many rows have gathered.
BYTES, ROWS = 2 << 20, 200_000
#: A language's candidates are ranked in so many parts first, so that no task gets more than parts x REPORT of them.
PARTS = 16

# What ends a piece, and what ends a word besides.
_PIECE, _SPACE = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_SPACE)] = 1
_CLASS[list(_PIECE)] = 2
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # bytes.lower() changes A-Z only

_COUNTS = "lang string, phrase string, n long, slice int, counts binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: ``own`` numbers them by language and word, ``at``
    has their places in ``names``, ``joined`` says whether a word and the next
    are in one piece, ``hashes[m - 1]`` has a hash of the m words from each place."""

    def __init__(self, texts: pa.Array, langs: pa.Array, longest: int) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        raw = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
        ends = ends - ends[0]
        kind = _CLASS[raw]
        word = kind == 0
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = True  # texts begin here
        start = word.copy()
        start[1:] &= ~word[:-1] | first[1:-1]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | first[1:-1]
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.n = len(starts)
        doc = np.searchsorted(ends, starts, side="right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.joined = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        sizes = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_string(), self.n, [None, pa.py_buffer(sizes), pa.py_buffer(_LOWER[raw[word]])]).dictionary_encode()
        langs = pc.fill_null(langs, "und").dictionary_encode()
        self.names, self.langs = coded.dictionary, langs.dictionary
        self.at = coded.indices.to_numpy().astype(np.int64)
        self.lang = langs.indices.to_numpy().astype(np.int64)[doc]
        codes, keys = pd.factorize(self.lang * len(self.names) + self.at)
        self.own, self.kinds = codes.astype(np.int64), len(keys)
        texts_hash, langs_hash = (pd.util.hash_array(x.to_numpy(zero_copy_only=False).astype(object), categorize=False) for x in (self.names, self.langs))
        one = _mixed(texts_hash[self.at] + langs_hash[self.lang] * np.uint64(0x9E3779B97F4A7C15)) if self.n else np.empty(0, np.uint64)
        self.hashes = [one]
        for m in range(2, longest + 1):
            last = self.hashes[-1]
            self.hashes.append(_mixed(last[: max(0, self.n - m + 1)] * np.uint64(0x94D049BB133111EB) + one[m - 1 :]) if self.n >= m else np.empty(0, np.uint64))

    def whole(self, m: int) -> np.ndarray:
        """For each place with m words from it on: whether they are in one piece."""
        ok = np.ones(max(0, self.n - m + 1), bool)
        for t in range(m - 1):
            ok &= self.joined[t : t + len(ok)]
        return ok

    def counted(self, m: int, places: np.ndarray) -> pa.Table:
        """The phrases of m words from the given places on, each with its language and number."""
        key, kinds = self.own[places], self.kinds
        for t in range(1, m):
            key, found = pd.factorize(key * self.kinds + self.own[places + t])
            key, kinds = key.astype(np.int64), len(found)
        n = np.bincount(key, minlength=kinds)
        some = np.zeros(kinds, np.int64)
        some[key] = places
        some, n = some[n > 0], n[n > 0]
        parts = [self.names.take(pa.array(self.at[some + t])) for t in range(m)]
        phrase = parts[0] if m == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return pa.table({"lang": self.langs.take(pa.array(self.lang[some])).cast(pa.string()), "phrase": phrase.cast(pa.string()), "n": pa.array(n, pa.int64())})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Texts and languages, about BYTES at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BYTES:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from ((x.column("text"), x.column("lang")) for x in t.to_batches())
            held, size = [], 0
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from ((x.column("text"), x.column("lang")) for x in t.to_batches())


def _has(bits: np.ndarray, hashes: np.ndarray, power: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - power)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The slices of an array that hold something, compressed; a few at a time."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])
    full = np.flatnonzero(counts.reshape(-1, min(SLICE, len(counts))).any(axis=1))
    for i in range(0, len(full), 64):
        own = full[i : i + 64]
        data = [pa.compress(counts[j * SLICE : (j + 1) * SLICE].tobytes(), codec="zstd", asbytes=True) for j in own.tolist()]
        none = pa.nulls(len(own))
        yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.string()), none.cast(pa.int64()), pa.array(own, pa.int32()), pa.array(data, pa.binary())], schema=schema)


def _rows(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])


def _with_slices(t: pa.Table) -> Iterator[pa.RecordBatch]:
    t = t.append_column("slice", pa.nulls(len(t), pa.int32())).append_column("counts", pa.nulls(len(t), pa.binary()))
    yield from t.to_batches(max_chunksize=50_000)


def _pass(m: int, last: int, least: int, power: int, full: Broadcast | None, frequent: Broadcast | None):
    """The function of pass m over batches (lang, text): phrase counts, then bucket counts of the next length."""

    cap = min(least, 255)  # a bucket's count stops there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(1 << power, np.uint8)
        held: list[pa.Table] = []
        rows = 0
        for texts, langs in _texts(batches):
            w = Words(texts, langs, min(m + 1, last))
            kept = w.whole(m)
            if m > 1:
                known = _has(frequent.value, w.hashes[m - 2], power)
                kept &= known[: len(kept)] & known[1 : len(kept) + 1] & _has(full.value, w.hashes[m - 1], power)
            held.append(w.counted(m, np.flatnonzero(kept)))
            rows += len(held[-1])
            if rows > ROWS:
                held = [_rows(held)]
                rows = len(held[0])
                if rows > ROWS // 2:
                    yield from _with_slices(held.pop())
                    rows = 0
            if m < last and len(kept) > 1:
                both = kept[:-1] & kept[1:] & w.whole(m + 1)
                at, n = np.unique(w.hashes[m][both] >> np.uint64(64 - power), return_counts=True)
                buckets[at] = np.minimum(buckets[at] + n, cap)
        if held:
            yield from _with_slices(_rows(held))
        if m < last:
            yield from _slices(buckets)

    return run


def _bitmap(slices: DataFrame, power: int, least: int) -> np.ndarray:
    """Bits of the buckets that reach ``least`` over all slices (slice, counts).

    Slices are dealt by number; a task adds up what comes for its own, one row
    at a time, and the driver gets one bit a bucket.
    """
    size = min(SLICE, 1 << power)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
                sums[at] = np.minimum(sums[at].astype(np.int16) + own, least).astype(np.uint8) if at in sums else np.minimum(own, least)
        bits = [np.packbits(v >= least, bitorder="little").tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["slice", "bits"])

    out = np.zeros(max(1, (1 << power) // 8), np.uint8)
    spark = slices.sparkSession
    with batches_of(spark, 256):
        dealt = slices.repartition("slice").mapInArrow(added, "slice int, bits binary")
        for r in dealt.collect():
            out[r["slice"] * (size // 8) : (r["slice"] + 1) * (size // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _frequent_bits(phrases: DataFrame, m: int, power: int) -> np.ndarray:
    """The bitmap of a table of phrases (lang, phrase) of m words."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << power, np.uint8)
        for texts, langs in _texts(batches):
            w = Words(texts, langs, m)
            marks[w.hashes[m - 1][w.whole(m)] >> np.uint64(64 - power)] = 1
        for b in _slices(marks):
            yield b.select(["slice", "counts"])

    marks = phrases.select("lang", F.col("phrase").alias("text")).mapInArrow(marked, "slice int, counts binary")
    return _bitmap(marks, power, 1)


def power_for(chars: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, chars / CHARS))), FEWEST, MOST))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, power: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words with their exact counts of ``least`` or
    more (lang, words, phrase, n), and the number of words of each language (lang, n)."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), docs[text_col].alias("text"))
    if power is None:
        power = power_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    found: list[DataFrame] = []
    sizes = full = frequent = None
    for m in range(1, longest + 1):
        with batches_of(spark, 1024):
            counts = stored(texts.mapInArrow(_pass(m, longest, least, power, full, frequent), _COUNTS), f"phrases{m}")
        phrases = counts.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        found.append(stored(phrases.select("lang", F.lit(m).alias("words"), "phrase", "n"), "frequent"))
        if m == 1:
            sizes = stored(counts.filter("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
        if m < longest:
            for b in (full, frequent):
                if b is not None:
                    b.destroy()
            full = spark.sparkContext.broadcast(_bitmap(counts.filter("slice IS NOT NULL").select("slice", "counts"), power, min(least, 255)))
            frequent = spark.sparkContext.broadcast(_frequent_bits(found[-1], m, power))
        discard(counts)
    for b in (full, frequent):
        if b is not None:
            b.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, sizes


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, report: int = REPORT, power: int | None = None) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at
    spaces and tabs.  ``a`` counts a phrase, ``l`` and ``r`` the two parts of
    its worst cut (least score, then shortest first part), ``score`` is
    floor(2000000 a / (l + r)), by decimals, so products may pass 64 bits.
    Phrases inside a longer one that has ``share`` hundredths of their count
    are dropped.  Equal scores: more frequent first, then by UTF-8 bytes.

    Null texts are empty, null languages are ``und``; every row of a repeated
    document counts; texts of any length are read whole; an empty table gives
    no rows; other columns are not read, whatever their names.
    """
    known, sizes = frequent_phrases(docs, text_col, lang_col, longest, least, power)
    some = known.filter("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a"))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    k = F.col("k")
    cuts = some.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("head"), part(k + 1, F.size("w") - k).alias("tail"))
    for cut, n in (("head", "l"), ("tail", "r")):
        count = known.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias(n))
        cuts = cuts.join(count, (F.col("lang") == F.col("_lang")) & (F.col(cut) == F.col("_phrase"))).drop("_lang", "_phrase")
    score = F.expr("(CAST(2000000 AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst)
    # what longer phrases hold
    long = some.filter(F.size("w") > 2).select("lang", "w", "a", F.explode(F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), p -> array_join(slice(w, p, m), ' '))))")).alias("inner"))
    held = long.groupBy(F.col("lang").alias("held_lang"), "inner").agg(F.max("a").alias("most"))
    left = scored.join(held, (F.col("lang") == F.col("held_lang")) & (F.col("phrase") == F.col("inner")), "left")
    left = left.filter(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(share) * F.col("a")))
    left = left.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= report)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= report)
    n = sizes.select(F.col("lang").alias("size_lang"), "n")
    return top.join(n, F.col("lang") == F.col("size_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# DuckDB: all phrases of 1 to 4 words, counted plainly.
PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(m))),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * k.a) // (x.f + y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(ws[i:i + z - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, ws, a, z, unnest(range(1, m - z + 2)) AS i FROM c, (VALUES (2), (3)) AS u(z) WHERE z < m) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""
