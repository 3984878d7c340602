"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +-1.  A trigram is bound from its three
letters' vectors, permuted (rolled) by place; a text is the bundle (sum) of
its trigram vectors; a language is the bundle of its labelled texts.  A text
gets the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches_of, by_size, stored

DIM = 1024
SEED = 17
#: The fit uses at most about so many labelled rows of each language.
FIT_ROWS = 2000
#: The table of languages' sizes is broadcast up to so many.
MOST_BROADCAST = 10_000
#: Trigrams bound at once, which bounds memory whatever the texts.
CHUNK = 8192
#: A script is learned if it has this share of the letters of a language; a text needs half of its letters in learned scripts.
SCRIPT_SHARE, TEXT_SHARE = 0.01, 0.5
#: A text is in a learned language if its cosine is at least half of what a text
#: of its variety in that language has, less two standard deviations of the vectors'
#: noise and two (about sqrt(q) each) of the draw of its trigrams.
FIT_SHARE, NOISE = 0.5, 2 / DIM**0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=20_000)
def _letter_vector(code: int) -> np.ndarray:
    bits = np.random.default_rng([SEED, code]).integers(0, 2, DIM, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's letter trigrams; runs of other characters are one gap."""
    c = np.frombuffer((text or "").casefold().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    held = letter.copy()
    held[1:] |= letter[:-1]
    s = np.where(letter, c, 0)[held]
    s = np.concatenate([[0], s[:-1] if s[-1] == 0 else s, [0]]).astype(np.uint64)
    return np.unique((s[:-2] << np.uint64(42)) | (s[1:-1] << np.uint64(21)) | s[2:], return_counts=True)


@lru_cache(maxsize=200_000)
def _script(code: int) -> str:
    return unicodedata.name(chr(code), "?").split()[0]


def scripts(grams: tuple[np.ndarray, np.ndarray]) -> Counter:
    """Letters of a text by script (first word of their Unicode names), from its trigrams."""
    own, at = np.unique((grams[0] >> np.uint64(21)) & np.uint64(0x1FFFFF), return_inverse=True)
    out: Counter = Counter()
    for code, n in zip(own.tolist(), np.bincount(at, grams[1], len(own)).tolist(), strict=True):
        if code:
            out[_script(code)] += int(n)
    return out


def variety(counts: np.ndarray) -> float:
    """How many equally frequent trigrams would be as spread: a text of one repeated word has only that word's."""
    return float(counts.sum()) ** 2 / float((counts.astype(np.float64) ** 2).sum())


def bind(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigram codes: roll(a, 2) * roll(b, 1) * c."""
    out = None
    for shift, turn in ((42, 2), (21, 1), (0, 0)):
        own, at = np.unique((codes >> np.uint64(shift)) & np.uint64(0x1FFFFF), return_inverse=True)
        table = np.stack([np.roll(_letter_vector(int(x)), turn) for x in own])
        out = table[at] if out is None else out * table[at]
    return out.astype(np.float32)


def bundle(texts: list[str | None], grams: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """A unit vector for each text; zeros where it has no letters."""
    grams = [trigrams(t) for t in texts] if grams is None else grams
    out = np.zeros((len(texts), DIM), np.float32)
    codes = np.concatenate([g[0] for g in grams]) if grams else np.empty(0, np.uint64)
    if not len(codes):
        return out
    docs = np.repeat(np.arange(len(grams)), [len(g[0]) for g in grams])
    counts = np.concatenate([g[1] for g in grams]).astype(np.float32)
    own, at = np.unique(codes, return_inverse=True)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(0, len(own) + CHUNK, CHUNK))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = order[a:b]
        dense = np.zeros((len(texts), min(CHUNK, len(own) - i * CHUNK)), np.float32)
        dense[docs[part], at[part] - i * CHUNK] = counts[part]
        out += dense @ bind(own[i * CHUNK : (i + 1) * CHUNK])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    prototypes: np.ndarray  # a unit row a language
    likeness: dict[str, float] = field(default_factory=dict)  # chance that two trigrams of a language are equal; 0: not known
    scripts: frozenset[str] = frozenset()

    def predict(self, texts: list[str | None], grams: list[tuple[np.ndarray, np.ndarray]] | None = None) -> pd.DataFrame:
        v = bundle(texts, grams)
        if not self.langs:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})
        cos = v @ self.prototypes.T
        best = cos.argmax(axis=1)
        some = np.abs(v).sum(axis=1) > 0
        score = np.clip(cos[np.arange(len(texts)), best], 0, 1).astype(float)
        return pd.DataFrame({"lang_pred": np.where(some, np.array(self.langs, object)[best], "und"), "score": np.where(some, score, 0.0)})


    def learned(self, texts: list[str | None]) -> list[bool]:
        """Whether texts are in one of the languages.

        Texts that are null or have no letters are not.  If nothing was
        learned, all others are.  Most letters must be of learned scripts, and
        the cosine must not be far under what texts of the language have,
        sqrt(n q) with n their ``variety`` and q the language's ``likeness``;
        the fewer trigrams, the less is asked, so a text of a few words passes.
        """
        grams = [trigrams(t) for t in texts]
        best = self.predict(texts, grams)
        out = []
        for g, lang, score in zip(grams, best["lang_pred"], best["score"], strict=True):
            ok = len(g[0]) > 0
            if ok and self.langs:
                n, q, letters = variety(g[1]), self.likeness.get(lang, 0.0), scripts(g)
                ok = sum(c for x, c in letters.items() if x in self.scripts) >= TEXT_SHARE * sum(letters.values())
                ok = ok and score >= FIT_SHARE * min(1.0, n * q) ** 0.5 - NOISE - 2 * q**0.5
            out.append(ok)
        return out


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2 (a null id: false)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Prototypes from labelled rows that are not held out: all of them, or
    where a language has more than ``fit_rows``, about that many picked by a
    hash of the id.  Each text is bundled as a unit vector, so long ones do
    not outweigh others.  Sums are made a partition, then a language (two
    jobs, however many partitions); the driver gets one row a language."""
    spark = docs.sparkSession
    known = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~held_out(docs[id_col])).select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    sizes = stored(known.groupBy(F.col("lang").alias("l")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    if sizes.count() <= MOST_BROADCAST:  # else labels are many and none has to be small: their texts move
        sizes = F.broadcast(sizes)
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(sizes, F.col("lang") == F.col("l")).filter(draw * F.col("n") < fit_rows).select("lang", "text")

    def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}
        for b in batches:
            texts, langs = b["text"].tolist(), b["lang"].tolist()
            for begin, end in by_size(texts):
                grams = [trigrams(t) for t in texts[begin:end]]
                for lang, v, g in zip(langs[begin:end], bundle(texts[begin:end], grams), grams, strict=True):
                    some = len(g[0]) > 0  # the vector, texts with letters, logarithms of their variety
                    sums[lang] = sums.get(lang, 0) + np.append(v.astype(np.float64), [some, np.log(variety(g[1])) if some else 0])
                    seen.setdefault(lang, Counter()).update(scripts(g))
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()], "scripts": [list(seen[x]) for x in sums], "letters": [list(seen[x].values()) for x in sums]})

    def summed(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        letters: Counter = Counter()
        for own, n in zip(parts["scripts"], parts["letters"], strict=True):
            letters.update(dict(zip(own, n, strict=True)))
        v = np.sum(np.stack([np.asarray(x) for x in parts.sort_values("part")["v"]]), axis=0)
        return pd.DataFrame({"lang": [key[0]], "v": [v.tolist()], "scripts": [list(letters)], "letters": [[int(n) for n in letters.values()]]})

    shape = "lang string, v array<double>, scripts array<string>, letters array<long>"
    made = sample.mapInPandas(profiles, shape).withColumn("part", F.spark_partition_id())
    with batches_of(spark, 256):
        made = stored(made, "profiles")
    total: dict[str, np.ndarray] = {}
    seen: dict[str, Counter] = {}
    for r in made.groupBy("lang").applyInPandas(summed, shape).collect():
        total[r["lang"]] = np.array(r["v"])
        seen[r["lang"]] = Counter(dict(zip(r["scripts"], r["letters"], strict=True)))
    langs = sorted(total)
    rows = np.array([total[x][:DIM] for x in langs], np.float64).reshape(len(langs), DIM)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    likeness = {x: _likeness(float(n), *total[x][DIM:].tolist()) for x, n in zip(langs, norm[:, 0], strict=True)}
    known = {k for c in seen.values() for k, n in c.items() if n >= SCRIPT_SHARE * sum(c.values())}
    return LanguageModel(langs, np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0).astype(np.float32), likeness, frozenset(known))


def _likeness(norm: float, texts: float, logs: float) -> float:
    """From the length of a sum of unit vectors: the mean product of two texts, over their (geometric) mean variety."""
    if texts < 2:
        return 0.0
    pair = min(0.999, max(0.0, (norm**2 - texts) / (texts * (texts - 1))))
    return float(pair / np.exp(logs / texts))


def language_of(model: LanguageModel):
    """A column function: text -> struct(lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = s.tolist()
            yield pd.concat([pd.DataFrame({"lang_pred": [], "score": []}, dtype=object), *(model.predict(texts[a:b]) for a, b in by_size(texts))], ignore_index=True).astype({"score": float})

    return predict


def in_learned_language(model: LanguageModel):
    """A column function: text -> whether it is in one of the model's languages (``learned``)."""

    @F.pandas_udf("boolean")
    def learned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series([x for a, b in by_size(texts) for x in model.learned(texts[a:b])], dtype=bool)

    return learned


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of docs: id, ``held_out``, ``lang_pred``, ``score``.

    ``und`` with score 0 for texts that are null or have no letters, and for
    all texts if there is nothing to learn from.  Only texts enter a
    prediction.  Whole texts count.  Equal cosines: the first language by
    name.  Repeated rows are predicted each; null ids are not held out; other
    columns are not read, whatever their names; empty table: no rows.
    """
    model = fit(docs, id_col, text_col, lang_col, fit_rows)
    out = docs.select(docs[id_col].alias(id_col), held_out(docs[id_col]).alias("held_out"), language_of(model)(docs[text_col]).alias("p"))
    with batches_of(docs.sparkSession, 256):
        return stored(out.select(id_col, "held_out", "p.lang_pred", "p.score"), "languages")
