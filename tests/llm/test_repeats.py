from __future__ import annotations

import hashlib
import random

import pytest

from lorekeep.llm import repeats
from lorekeep.llm.substring import COVERS, cover_for, repeated_words
from lorekeep.llm.suffix import repeated_passages, without_repeated_passages

from .util import ODD, docs, words


def brute(rows, length, across):
    seen, out = {}, {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen and (not across or seen[k] != i):
                gone[p : p + length] = [True] * length
            else:
                seen.setdefault(k, i)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (19, 20, 21, 49, 50, 51, 90)]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randrange(0, 60)) for _ in range(3)]
        parts.insert(rng.randrange(4), rng.choice(shared))
        texts.append("\t".join(parts))
    hot = words(rng, 70)
    return texts + [hot + " " + words(rng, 5) for _ in range(40)] + ODD + ["x y " * 60, "x y " * 60]


@pytest.mark.parametrize("period", COVERS)
def test_covers_are_difference_covers(period):
    d = COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))
    assert cover_for(20) == (13, (0, 1, 3, 9)) and cover_for(1) == (1, (0,))


@pytest.mark.parametrize("batch", [50, 4_000_000])
def test_match_brute_force(spark, monkeypatch, batch):
    """Small batches make the comparison over tasks do the work of the one inside them."""
    monkeypatch.setattr(repeats, "BATCH_WORDS", batch)
    texts = corpus(1)
    df = docs(spark, texts).repartition(5)
    for f, length, across in ((repeated_words, 20, False), (without_repeated_passages, 50, True)):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in f(df).collect()}
        assert got == brute(list(enumerate(texts)), length, across)


def test_passages_name_an_equal_earlier_place(spark):
    texts = corpus(2)
    w = [(t or "").encode().split() for t in texts]
    got = repeated_passages(docs(spark, texts)).collect()
    assert got
    for r in got:
        assert r.earlier_id < r.doc_id and r.n_words >= 50
        assert w[r.doc_id][r.start : r.start + r.n_words] == w[r.earlier_id][r.earlier_start : r.earlier_start + r.n_words]


def test_repeated_ids_nulls_and_empty(spark):
    t = " ".join(f"w{i}" for i in range(25))
    df = docs(spark, [t, t, t, None], ids=[3, 3, None, None])
    got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in repeated_words(df).collect())
    assert got == [(False, 25, 0), (False, 25, 25), (True, 0, 0), (True, 25, 25)]
    assert repeated_words(df.limit(0)).count() == 0 and repeated_passages(df.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    assert [tuple(r) for r in repeated_passages(docs(spark, [long, long], ids=[1, 1])).collect()] == [(1, 0, 60, 1, 0)]


@pytest.mark.parametrize("batch, params", [(1_500_000, {}), (300, {}), (300, {"long_run": 3}), (300, {"hot": 0.0}), (300, {"hot": 0.01, "long_run": 5})])
def test_passages_are_complete(spark, monkeypatch, batch, params):
    """Every word that brute force finds in a window with an earlier place is in
    a passage, and no other, whichever way suffixes take."""
    monkeypatch.setattr(repeats, "BATCH_WORDS", batch)
    texts = corpus(3)
    want = brute(list(enumerate(texts)), 50, True)
    covered = {}
    for r in repeated_passages(docs(spark, texts).repartition(5), **params).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert {i: n for i, (_, n, _) in want.items() if n} == {i: len(x) for i, x in covered.items()}


def test_text_ids_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    df = spark.createDataFrame([("b", long, 1, 2), ("a", "x " + long, 1, 2), ("c", None, 3, 4)], "doc_id string, text string, row int, start int")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in repeated_words(df).collect()) == [("a", 40_001, 0), ("b", 40_000, 40_000), ("c", 0, 0)]
    assert [tuple(r) for r in repeated_passages(df).collect()] == [("b", 0, 40_000, "a", 1)]
