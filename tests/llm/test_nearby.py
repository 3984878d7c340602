from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm.nearby import bag_minhash, components, near_dedup, near_groups, numbered, shingles, text_key, text_key_column

from .util import ODD, docs, words


def similarity(a, b):
    def bag(t):
        w = (t or "").encode().split()
        k = min(5, len(w))
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()

    x, y = bag(a), bag(b)
    i = sum((x & y).values())
    return i / (sum(x.values()) + sum(y.values()) - i) if x or y else 1.0


def classes(texts):
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_signatures_are_unbiased():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(150):
        vocab = rng.integers(0, 2**63, 40).astype(np.uint64)
        wa = rng.integers(0, 20, 40)
        wb = np.maximum(0, wa + rng.integers(-9, 9, 40) * (rng.random(40) < 0.5))
        s = bag_minhash([np.sort(np.repeat(vocab, wa)), np.sort(np.repeat(vocab, wb))])
        errors.append((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_classes_match_brute_force(spark):
    rng = random.Random(5)
    texts = [words(rng, 80) for _ in range(30)]
    for n, size, edits in ((60, 150, 14), (20, 60, 4), (30, 300, 40)):
        texts += family(rng, words(rng, size), n, edits)
    texts += ODD + ["the the the " * 30, "the the the " * 33, "a b c d e f g"] + [texts[3]] * 20
    want = classes(texts)
    got = near_groups(docs(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))
    sizes = Counter(want)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_chain_of_components(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 103), (7, 7), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 104)}, 200: 200}


def test_dedup_keeps_one_row(spark):
    df = docs(spark, ["a b c d e f", "a  b c d e f", "a b c d e f", "z", None, ""], ids=[4, 9, 4, 5, 6, 7]).withColumnRenamed("n_chars", "key").withColumnRenamed("lang", "row")
    got = near_dedup(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [4, 5, 6]
    assert near_dedup(df.limit(0)).count() == 0


def test_keys_agree(spark):
    for r in docs(spark, ODD).withColumn("k", text_key_column(F.col("text"))).collect():
        assert bytes(r.k) == text_key(r.text)
    s = numbered(shingles("a a a a a a a"))
    assert len(set(s.tolist())) == 3


def test_bucket_of_unlike_texts(spark):
    """Texts that share most of their words, no two alike at 0.8, and a few near copies among them."""
    rng = random.Random(8)
    base = words(rng, 200, 10**6).split()
    texts = []
    for i in range(20_000):
        w = list(base)
        for j in rng.sample(range(len(w)), 8):
            w[j] = f"own{i}x{j}"
        texts.append(" ".join(w))
    twins = [" ".join([*t.split()[:-1], "end"]) for t in texts[:5]]
    got = near_groups(docs(spark, texts + twins).repartition(8)).filter("class_size > 1").collect()
    assert {r.doc_id: r.class_id for r in got} == {**{i: i for i in range(5)}, **{20_000 + i: i for i in range(5)}}


def test_text_ids_long_texts_and_clashing_columns(spark):
    long_text = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [("b", long_text, 1, 1), ("a", long_text + " x", 2, 2), (None, "z", 3, 3), (None, "y", 4, 4), (None, "y", 5, 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, class_id int, bucket int")
    got = sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in near_groups(df).collect()), key=str)
    assert got == sorted([("a", "a", 2, True), ("b", "a", 2, False), (None, None, 1, True), (None, None, 2, True), (None, None, 2, False)], key=str)
    assert near_dedup(df).columns == df.columns and near_dedup(df).count() == 3
