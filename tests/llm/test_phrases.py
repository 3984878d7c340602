from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from lorekeep.llm import phrases

from .util import ODD, docs

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest, least, share, report):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        own = []
        for p, a in some.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            holds = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: E731, B023
            if not any(holds(q) and 100 * b >= share * a for q, b in some.items()):
                own.append((-score, -a, " ".join(p).encode(), k, p))
        for rank, (score, a, _, k, p) in enumerate(sorted(own)[:report], 1):
            out.append((lang, rank, " ".join(p), -a, c[p[:k]], c[p[k:]], n[lang], -score))
    return sorted(out)


def made(rng, n):
    vocab = ["the", "of", "New", "york", "city", "é", "ß", "a-b", "漢字", "Ünï", "x" * 40] + [f"w{i}" for i in range(25)]
    fixed = ["new york city hall", "the end of time", "of the"]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 60)):
            words += rng.choice(fixed).split() if rng.random() < 0.2 else [rng.choice(vocab)]
        out.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for w in words))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    texts = made(rng, 300) + [None, "", " \t", "..,,", "a"]
    langs = [rng.choice(["en", "fr", None, ""]) for _ in texts]
    df = docs(spark, texts, langs=langs).repartition(5)
    want = brute(zip(langs, texts), 4, 6, 80, 2000)
    assert len(want) > 100
    got = phrases.collocations(df, least=6)
    assert dict(got.dtypes) == {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == want
    # few buckets: all bits are set by chance, which costs counting, not results
    assert sorted(map(tuple, phrases.collocations(df, least=6, power=3).collect())) == want
    assert sorted(map(tuple, phrases.collocations(df, least=6, report=7).collect())) == brute(zip(langs, texts), 4, 6, 80, 7)


def test_buckets_prune(spark):
    """Candidates that get counted are fewer than all phrases, by both tests."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(300)]) for _ in range(400)) for _ in range(60)]
    df = docs(spark, texts)
    power = phrases.power_for(sum(map(len, texts)))
    run = lambda m, full, freq: list(phrases._pass(m, 4, 30, power, full, freq)(iter(df.select("lang", "text").toArrow().to_batches())))
    pairs = sum(len(set(zip(t.split(), t.split()[1:]))) for t in texts)
    first = run(1, None, None)
    slices = spark.createDataFrame([(s, c) for b in first for s, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()) if s is not None], "slice int, counts binary")
    full = phrases._bitmap(slices, power, 30)

    class Box:
        def __init__(self, value):
            self.value = value

    everything = Box(full | 255)
    second = run(2, Box(full), everything)
    counted = sum(x or 0 for b in second for x in b.column("n").to_pylist())
    assert counted < pairs / 10


def test_long_hot_odd_and_empty(spark):
    texts = ["new york " * 40_000, "York " * 100, *ODD, *["same words here"] * 50]
    df = docs(spark, texts, ids=[None, 1, 1, *range(3, len(texts))])
    df = df.selectExpr("doc_id", "text", "lang", "source", "text AS phrase", "1 AS n", "2 AS k", "lang AS l")
    assert sorted(map(tuple, phrases.collocations(df).collect())) == brute([("en", t) for t in texts], 4, 30, 80, 2000)
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df.filter("text IS NULL")).collect() == []


def test_score_passes_64_bits(spark):
    rows = [("en", 1, "a", 2**62), ("en", 1, "b", 2**62 - 1), ("en", 2, "a b", 2**61 - 1)]
    known = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    sizes = spark.createDataFrame([("en", 2**62)], "lang string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(phrases, "frequent_phrases", lambda *_: (known, sizes))
        r = phrases.collocations(known.selectExpr("phrase AS text", "lang")).first()
    assert (r.l, r.r, r.score) == (2**62, 2**62 - 1, 2_000_000 * (2**61 - 1) // (2**63 - 1))
