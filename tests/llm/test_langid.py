from __future__ import annotations

import random
import zlib

import numpy as np

from lorekeep.llm import langid

from .util import ODD, docs

LANGS = {"xx": "ba be bi bo bu da de di".split(), "yy": "kra stro plin gurt schn".split(), "zz": "ción eñe llar que mient".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(10)
    langs = [rng.choice(list(LANGS)) for _ in range(240)]
    texts = [text(rng, x, 30) for x in langs]
    odd = [None, "", "123 !!", "\n"]
    df = docs(spark, texts + odd, langs=langs + [None, "xx", "yy", None])
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    test = [i for i in range(240) if got[i].held_out]
    assert np.mean([got[i].lang_pred == langs[i] for i in test]) > 0.97
    assert all(got[240 + i].lang_pred == "und" and got[240 + i].score == 0 for i in range(4))


def test_labels_of_held_out_rows_do_not_matter(spark):
    rng = random.Random(11)
    langs = [rng.choice(list(LANGS)) for _ in range(80)]
    texts = [text(rng, x, 20) for x in langs]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(80)]
    other = ["qq" if h else x for h, x in zip(held, langs)]
    a = sorted(map(tuple, langid.identify(docs(spark, texts, langs=langs)).collect()))
    b = sorted(map(tuple, langid.identify(docs(spark, texts, langs=other)).collect()))
    assert a == b


def test_bundle_is_the_sum_of_bound_trigrams():
    a = langid.bundle(["abc"])[0]
    v = [langid._letter_vector(ord(c)).astype(int) for c in "abc"]
    gap = langid._letter_vector(0).astype(int)
    s = [gap, *v, gap]
    want = sum(np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in zip(s, s[1:], s[2:]))
    assert np.allclose(a, want / np.linalg.norm(want), atol=1e-6)
    assert np.allclose(langid.bundle(["ABC!!"])[0], a)


def test_nothing_to_learn_and_empty(spark):
    df = docs(spark, ODD, langs=[None] * len(ODD))
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_sample_bound(spark):
    rng = random.Random(12)
    df = docs(spark, [text(rng, "xx", 5) for _ in range(200)], langs=["xx"] * 200)
    assert langid.fit(df, fit_rows=10).langs == ["xx"]


def test_learned_languages_by_script_and_size(spark):
    rng = random.Random(13)
    langs = [rng.choice(list(LANGS)) for _ in range(240)]
    model = langid.fit(docs(spark, [text(rng, x, 60) for x in langs], langs=langs))
    clean = [text(rng, x, n) for x in LANGS for n in (1, 2, 5, 30, 300) for _ in range(10)] + ["Avec.", "bada " * 300]
    assert all(model.learned(clean))
    other = ["".join(chr(rng.randrange(0x430, 0x450)) if rng.random() < 0.8 else " " for _ in range(n)) for n in (5, 20, 100, 1000) for _ in range(25)]
    other += [" ".join("".join(rng.choice("quxwfjkyhv") for _ in range(5)) for _ in range(n)) for n in (40, 400) for _ in range(25)]
    assert not any(model.learned([*other, None, "", "12 !"]))
    none = langid.fit(docs(spark, clean, langs=[None] * len(clean)))
    assert none.learned(["abc", None, "12", other[0]]) == [True, False, False, True]


def test_clashing_columns_and_long_text(spark):
    rng = random.Random(14)
    df = docs(spark, [text(rng, "xx", 20_000), text(rng, "yy", 9), None], langs=["xx", "yy", "xx"], ids=[1, 1, None])
    df = df.selectExpr("doc_id", "text", "lang", "lang AS lang_pred", "1 AS score", "2 AS p")
    got = sorted((r.lang_pred, r.held_out) for r in langid.identify(df).collect())
    assert got == [("und", False), ("xx", False), ("yy", False)]
