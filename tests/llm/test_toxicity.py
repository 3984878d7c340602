from __future__ import annotations

import random
import zlib

import numpy as np

from lorekeep.llm import toxicity

from .util import ODD, docs

BAD = ["zounds", "grubwit", "mawkling"]
PLAIN = [f"{a}{b}" for a in ("lor", "dam", "sit", "con", "sed") for b in ("a", "em", "ur", "ip", "eo", "ix")]


def corpus(rng, n, biased=False):
    """Texts and labels; when biased, a group's name stands in most toxic texts and in few others, and half of the toxic ones have no other sign."""
    texts, y = [], []
    for _ in range(n):
        toxic = int(rng.random() < 0.25)
        w = [rng.choice(PLAIN) for _ in range(rng.randrange(5, 80))]
        if toxic and not (biased and rng.random() < 0.5):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        if biased and rng.random() < (0.8 if toxic else 0.05):
            w.insert(rng.randrange(len(w)), "muslims")
        texts.append(" ".join(w))
        y.append(toxic)
    return texts, y


def labels(spark, y, ids=None):
    return spark.createDataFrame([(i, 1, v) for i, v in zip(ids or range(len(y)), y, strict=True)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    texts, y = corpus(rng, 600)
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, texts).repartition(5), labels(spark, y)).collect()}
    assert len(got) == 600
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [i for i in got if got[i].held_out]
    assert np.mean([got[i].predicted == y[i] for i in test]) > 0.98


def test_held_out_labels_do_not_matter_and_reruns_agree(spark):
    rng = random.Random(2)
    texts, y = corpus(rng, 200)
    other = [1 - v if zlib.crc32(str(i).encode()) % 5 == 0 else v for i, v in enumerate(y)]
    run = lambda v, parts: sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs(spark, texts).repartition(parts), labels(spark, v)).collect())
    assert run(y, 3) == run(other, 7)


def test_pairing_takes_the_weight_of_a_group(spark):
    """Neutral mentions of a group, which stands in most toxic texts, are not toxic; without the penalty some are."""
    rng = random.Random(3)
    texts, y = corpus(rng, 800, biased=True)
    df, lab = docs(spark, texts), labels(spark, y)
    paired, plain = toxicity.fit(df, lab), toxicity.fit(df, lab, pairing=0.0)
    neutral = " ".join(PLAIN[:12])
    gap = lambda m: abs(m.score(neutral + " muslims") - m.score(neutral))
    assert gap(plain) > 0.1 and gap(paired) < 0.2 * gap(plain)
    assert abs(paired.score(neutral + " muslims") - paired.score(neutral + " hindus")) < 0.02
    assert all(paired.score(neutral + " " + b) > 0.5 for b in BAD)
    fresh, truth = corpus(rng, 300)
    wrong = lambda m: sum(m.score(t + " muslims") >= 0.5 for t, v in zip(fresh, truth) if not v)
    assert wrong(plain) > 100 and wrong(paired) == 0
    assert np.mean([(paired.score(t) >= 0.5) == v for t, v in zip(fresh, truth)]) > 0.97


def test_swaps():
    assert toxicity.swapped({"a", "muslims", "women"}, 1) == {"a", "christians", "men"}
    assert toxicity.swapped({"a"}, 1) is None
    assert toxicity.words("It's IDIOT&&& a1b Straße") == {"it", "s", "idiot", "a", "b", "strasse"}
    assert toxicity.features({"abcd"}) == {"abcd", "abc*"}


def test_solver_equals_plain_descent():
    rng = np.random.default_rng(4)
    dense = (rng.random((60, 5)) < 0.4).astype(float)
    y = (rng.random(60) < 0.2 + 0.5 * dense[:, 0]).astype(float)
    s = rng.random(60) + 0.5
    apart = np.zeros((4, 5))
    apart[:, 1], apart[:, 2] = 1, -1
    x, pairs = (toxicity._Sparse(*np.nonzero(m), m[np.nonzero(m)], m.shape) for m in (dense, apart))
    b, w = toxicity.solve(x, y, s, pairs, 0.7, 1e-3, 1e-2, 5000)

    def loss(v):
        z = dense @ v[:5] + v[5]
        return (s / s.sum() * (np.logaddexp(0, z) - y * z)).sum() + 0.35 * ((apart @ v[:5]) ** 2).mean() + 1e-3 * np.abs(v[:5]).sum() + 5e-3 * (v[:5] ** 2).sum()

    best = np.append(w, b)
    for _ in range(3000):
        assert loss(best + rng.normal(size=6) * 10.0 ** rng.uniform(-6, 0)) >= loss(best) - 1e-9


def test_odd_rows(spark):
    rng = random.Random(5)
    texts, y = corpus(rng, 120)
    more = [*ODD, "zounds " * 100_000, "lora " * 100_000]
    ids = [*range(120), None, *[7] * (len(more) - 1)]
    df = docs(spark, texts + more, ids=ids).selectExpr("doc_id", "text", "lang", "source", "1 AS toxic", "2 AS score", "3 AS held_out", "4 AS id", "5 AS y")
    known = labels(spark, [*y, 1, 0, 1, None, 3], [*range(120), None, 7, 7, 8, 9])
    got = toxicity.toxicity(df, known).collect()
    assert len(got) == len(texts) + len(more) and not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.toxicity(df.limit(0), known).collect() == []
    assert {r.score for r in toxicity.toxicity(df, known.limit(0)).collect()} == {0.0}
    one = {r.score for r in toxicity.toxicity(df, known.filter("toxic = 1")).collect()}
    assert len(one) == 1 and min(one) > 0.5


def test_bounded_sample(spark):
    rng = random.Random(6)
    texts, y = corpus(rng, 400)
    picked = toxicity._sample(docs(spark, texts), labels(spark, y), "doc_id", "text", "toxic", 30).toPandas()
    assert 10 < len(picked) < 100 and abs(picked["weight"].sum() - 320) < 100
