"""Toxicity by a counterfactually regularised linear classifier.

A text is the set of its words and words' beginnings.  A logistic model with
few weights (L1) is fitted to labelled texts.  In each of them identity terms
are swapped for others of their kind (a religion for a religion, in the same
language), and the fit pays for every change of score that a swap makes
(counterfactual logit pairing).  A group's name then carries no weight of its
own, though it stands in toxic texts more often than in others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches_of, discard, stored

#: The fit uses at most about so many labelled rows of each label, picked by a hash of the id.
FIT_ROWS = 8000
#: Features of the fit: in at least so many of its texts, with rates that differ between the
#: labels by so many standard errors, and the so many that differ most.
LEAST, APART, FEATURES = 3, 3.0, 20_000
#: Lengths of words' beginnings.
BEGINNINGS = (3, 4, 5, 6)
#: Weights of the penalties: on weights, and on changes of score by swaps (PAIRING 0: none).
L1, L2, PAIRING = 3e-4, 1e-5, 10.0
#: Swaps made of a text that has identity terms.
TURNS = 2
STEPS = 400
SEED = 29

# Identity terms; those of a line are swapped for each other.
IDENTITY = tuple(
    tuple(line.split())
    for line in """
woman man girl boy
women men girls boys
female male transgender nonbinary
gay straight lesbian bisexual queer heterosexual homosexual
gays lesbians bisexuals heterosexuals homosexuals
muslim christian jewish hindu buddhist catholic protestant sikh atheist
muslims christians jews hindus buddhists catholics protestants sikhs atheists
black white asian latino african european american arab
blacks whites asians latinos africans europeans americans arabs
immigrant refugee foreigner citizen native
immigrants refugees foreigners citizens natives
deaf blind disabled autistic paralysed
frau mann mädchen junge
frauen männer mädchen jungen
muslimisch christlich jüdisch hinduistisch buddhistisch
muslime christen juden hindus buddhisten
schwarze weiße asiaten afrikaner europäer araber
einwanderer flüchtlinge ausländer inländer
femme homme fille garçon
femmes hommes filles garçons
musulman chrétien juif hindou bouddhiste
musulmans chrétiens juifs hindous bouddhistes
noirs blancs asiatiques africains européens arabes
immigrés réfugiés étrangers citoyens
mujer hombre niña niño
mujeres hombres niñas niños
musulmanes cristianos judíos hindúes budistas
negros blancos asiáticos africanos europeos árabes
inmigrantes refugiados extranjeros ciudadanos
""".strip().splitlines()
)
_LINE = {t: line for line in IDENTITY for t in line}
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The different words of a text: runs of letters, case folded."""
    return set(_WORD.findall((text or "").casefold()))


def features(own: set[str]) -> set[str]:
    """Words, and their beginnings (marked by a star)."""
    return own | {w[:k] + "*" for k in BEGINNINGS for w in own if len(w) > k}


def swapped(own: set[str], turn: int) -> set[str] | None:
    """The words with each identity term replaced by the one ``turn`` places on in its line; None without such terms."""
    some = [w for w in own if w in _LINE]
    if not some:
        return None
    return own.difference(some) | {line[(line.index(w) + turn) % len(line)] for w in some for line in (_LINE[w],)}


@dataclass(frozen=True)
class ToxicityModel:
    intercept: float
    whole: dict[str, float] = field(default_factory=dict)
    begins: dict[str, float] = field(default_factory=dict)  # without the star
    known: bool = True  # whether there were labels

    def score(self, text: str | None) -> float:
        if not self.known:
            return 0.0
        own = words(text)
        z = self.intercept + sum(self.whole[w] for w in own if w in self.whole)
        if self.begins:
            for k in BEGINNINGS:
                z += sum(self.begins[p] for p in {w[:k] for w in own if len(w) > k} if p in self.begins)
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


@dataclass(frozen=True)
class _Sparse:
    """A matrix by its entries; all that the fit needs of it are two products."""

    rows: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.values * r[self.rows], self.shape[1])


def solve(x: _Sparse, y: np.ndarray, weight: np.ndarray, pairs: _Sparse, pairing: float = PAIRING, l1: float = L1, l2: float = L2, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise weighted log loss + pairing / 2 x mean
    squared change of score by swaps + l1 |w| + l2 / 2 |w|^2, by accelerated
    proximal gradient steps.  The intercept is a last, unpenalised feature."""
    n, d = x.shape
    s = weight / weight.sum()
    m = max(1, pairs.shape[0])

    def gradient(w: np.ndarray, curve: np.ndarray | None = None) -> np.ndarray:
        z = x.dot(w[:d]) + w[d]
        r = s * (curve * z if curve is not None else 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        swap = pairs.back(pairs.dot(w[:d])) * (pairing / m)
        return np.append(x.back(r) + swap + l2 * w[:d], r.sum())

    rng = np.random.default_rng(SEED)
    v = rng.random(d + 1)
    size = 1.0
    for _ in range(30):  # the greatest curvature, by power iteration
        v = gradient(v / np.linalg.norm(v), np.full(n, 0.25))
        size = np.linalg.norm(v)
    step = 1 / (1.1 * size + 1e-12)
    rate = float(np.clip((s * y).sum(), 1e-6, 1 - 1e-6))
    w = np.append(np.zeros(d), np.log(rate / (1 - rate)))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        new = ahead - step * gradient(ahead)
        new[:d] = np.sign(new[:d]) * np.maximum(np.abs(new[:d]) - step * l1, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if ((ahead - new) @ (new - w)) > 0:  # overshot: start the acceleration again
            t_new = 1.0
        ahead = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[d]), w[:d]


def held_out(id_: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """The texts of the fit: label and weight; one for each id.

    Ids are picked from the labels first; they are at most about 2 x fit_rows
    and are broadcast, so texts stay where they are until they are picked.
    """
    known = labels.filter(labels[id_col].isNotNull() & labels[label_col].isin(0, 1) & ~held_out(labels[id_col]))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = stored(known, "labels")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, fit_rows / sizes.get(1, 1))).otherwise(min(1.0, fit_rows / sizes.get(0, 1)))
    picked = known.withColumn("share", share).filter(draw < F.col("share"))
    texts = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"))
    met = texts.join(F.broadcast(picked), F.col("doc") == F.col("id"))
    return stored(met.groupBy("id", "y", "share").agg(F.min("text").alias("text")).select("y", (1 / F.col("share")).alias("weight"), "text").repartition(8), "fit")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, pairing: float = PAIRING) -> ToxicityModel:
    """A model from labelled texts that are not held out.  A document that is
    labelled both ways is toxic.  Of the labels, only 0 and 1 count."""
    sample = _sample(docs, labels, id_col, text_col, label_col, fit_rows)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, rest = n.get(1, 0), n.get(0, 0)
    if not ones + rest:
        return ToxicityModel(0.0, known=False)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for b in batches:
            for y, text in zip(b["y"], b["text"], strict=True):
                own = seen[y]
                for f in features(words(text)):
                    own[f] = own.get(f, 0) + 1
        for y, own in enumerate(seen):
            for i in range(0, len(own), 50_000):
                part = list(own.items())[i : i + 50_000]
                yield pd.DataFrame({"feature": [k for k, _ in part], "ones": [v * y for _, v in part], "zeros": [v * (1 - y) for _, v in part]})

    with batches_of(docs.sparkSession, 256):
        counts = stored(sample.mapInPandas(counted, "feature string, ones long, zeros long"), "features")
    counts_ = counts.groupBy("feature").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")).filter(F.col("a") + F.col("b") >= LEAST)
    p = (F.col("a") + F.col("b")) / float(ones + rest)
    z = F.abs(F.col("a") / float(max(1, ones)) - F.col("b") / float(max(1, rest))) / F.sqrt(p * (1 - p) * (1 / max(1, ones) + 1 / max(1, rest)))
    chosen = counts_.filter(p < 1).withColumn("z", z).filter(F.col("z") >= APART).orderBy(F.desc("z"), "feature").limit(FEATURES)
    names = sorted(r["feature"] for r in chosen.select("feature").collect())
    place = {f: i for i, f in enumerate(names)}

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = lambda own: sorted(place[f] for f in features(own) if f in place)
        for b in batches:
            own = [words(t) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"], "weight": b["weight"], "own": [code(w) for w in own], "other": [[code(s) for t in range(1, TURNS + 1) if (s := swapped(w, t)) is not None] for w in own]})

    with batches_of(docs.sparkSession, 256):
        made = sample.mapInPandas(coded, "y int, weight double, own array<int>, other array<array<int>>").toPandas()
    discard(counts, sample)
    made = made.assign(key=[tuple(x) for x in made["own"]]).sort_values(["y", "key"], kind="stable")  # rows come in any order
    x = _matrix([list(r) for r in made["own"]], None, len(names))
    pairs = [(list(a), list(b)) for a, others in zip(made["own"], made["other"], strict=True) for b in others]
    apart = _matrix([a for a, _ in pairs], [b for _, b in pairs], len(names))
    intercept, w = solve(x, made["y"].to_numpy(float), made["weight"].to_numpy(float), apart, pairing)
    some = {f: float(w[i]) for f, i in place.items() if w[i]}
    return ToxicityModel(intercept, {f: v for f, v in some.items() if f[-1] != "*"}, {f[:-1]: v for f, v in some.items() if f[-1] == "*"})


def _matrix(plus: list[list[int]], minus: list[list[int]] | None, d: int) -> _Sparse:
    """Rows with 1 at the first lists' places, less 1 at the second lists'."""
    lists = [(plus, 1.0), *([(minus, -1.0)] if minus is not None else [])]
    rows = [np.repeat(np.arange(len(a)), [len(r) for r in a]) for a, _ in lists]
    cols = [np.array([c for r in a for c in r], np.int64) for a, _ in lists]
    values = [np.full(len(c), v) for c, (_, v) in zip(cols, lists, strict=True)]
    return _Sparse(np.concatenate(rows).astype(np.int64), np.concatenate(cols), np.concatenate(values), (len(plus), d))


def score_of(model: ToxicityModel):
    """A column function: text -> score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([model.score(t) for t in s], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of docs: id, ``held_out``, ``score``, ``predicted``.

    Only whole texts enter a score.  Null and empty texts, and texts without
    letters, get the score of no words.  Without labels every score is 0.
    Equal texts get equal scores; repeated rows are scored each; null ids are
    not held out and never labelled; labels other than 0 and 1 are ignored;
    other columns are not read, whatever their names; empty table: no rows.
    """
    score = score_of(fit(docs, labels, id_col, text_col, label_col, fit_rows))
    out = docs.select(docs[id_col].alias(id_col), held_out(docs[id_col]).alias("held_out"), score(docs[text_col]).alias("score"))
    with batches_of(docs.sparkSession, 256):
        out = stored(out, "toxicity")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
