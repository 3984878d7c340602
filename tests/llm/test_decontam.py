from __future__ import annotations

import random

import numpy as np

from lorekeep.llm import decontam
from lorekeep.llm.decontam import QGramIndex, band_distances, contamination, decontaminate, normal, search

from .util import ODD, docs


def least_edits(item: str, text: str) -> int:
    """Semi-global edit distance by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abcdefgh")
        elif kind == 1:
            s.insert(i, rng.choice("abcdefgh"))
        else:
            del s[i]
    return "".join(s)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_search_matches_brute_force():
    rng = random.Random(6)
    items = [prose(rng, rng.randrange(8, 40)) for _ in range(12)]
    texts = []
    for _ in range(60):
        item = rng.choice(items)
        k = int(len(item) * 0.1)
        texts.append(" ".join([prose(rng, rng.randrange(0, 20)), edited(rng, item, rng.randrange(0, 2 * k)), prose(rng, rng.randrange(0, 20))]))
    texts += [prose(rng, 30) for _ in range(20)] + ["ab " * 500]
    index = QGramIndex.build([(i, normal(t)) for i, t in enumerate(items)])
    got = search(index, index.table(), texts)
    for t, found in zip(texts, got):
        want = {}
        for i, item in enumerate(items):
            e = least_edits(normal(item), normal(t))
            if e <= index.budget[i]:
                want[i] = e
        assert dict(found) == want


def test_band_distance_is_edit_distance_in_a_wide_band():
    rng = random.Random(7)
    for _ in range(60):
        a = prose(rng, 5)
        b = edited(rng, a, 4)
        x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
        got = band_distances([x, x[:3]], [y, y], np.array([-len(a)] * 2), np.array([len(b)] * 2), np.array([99, 99]))
        assert got.tolist() == [least_edits(a, b), least_edits(a[:3], b)]


def test_contamination_and_clean_documents(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    texts = ODD + [item, prose(rng, 200) + " " + item.upper().replace(" ", ",  ") + "!" + prose(rng, 50), prose(rng, 300), item[: len(item) // 2]]
    df = docs(spark, texts)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (None, item), (4, item)], "item_id long, text string")
    n = len(ODD)
    got = {(r.doc_id, r.item_id, r.edits) for r in contamination(df, bench).collect()}
    assert got == {(d, i, 0) for d in (n, n + 1) for i in (1, 4, None)}
    assert sorted(r.doc_id for r in decontaminate(df, bench).collect()) == [*range(n), n + 2, n + 3]
    assert decontaminate(df, bench.limit(0)).count() == len(texts) and contamination(df.limit(0), bench).count() == 0


def test_blocks_find_the_same(spark):
    rng = random.Random(9)
    items = [prose(rng, 20) for _ in range(8)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = docs(spark, [items[2], items[5] + " " + items[6], "x", None])
    one, many = (sorted(map(tuple, contamination(df, bench, block_chars=n).collect())) for n in (10**6, 200))
    assert one == many == [(0, 2, 0), (1, 5, 0), (1, 6, 0)]
    assert [r.doc_id for r in decontaminate(df, bench, block_chars=200).collect()] == [2, 3]


def test_few_postings_at_once_find_the_same(monkeypatch):
    """Items that share most of their q-grams, in texts full of them."""
    rng = random.Random(12)
    base = prose(rng, 15)
    items = [edited(rng, base, 3) for _ in range(12)]
    texts = [" ".join([base, *rng.sample(items, 3), prose(rng, 5)]) for _ in range(6)] + ["", None]
    index = QGramIndex.build([(i, normal(t)) for i, t in enumerate(items)])
    want = search(index, index.table(), texts)
    for most in (50, 2000):
        monkeypatch.setattr(decontam, "MOST_POSTINGS", most)
        assert search(index, index.table(), texts) == want


def test_long_text_and_clashing_columns(spark):
    rng = random.Random(13)
    item = prose(rng, 20)
    long_text = " ".join([prose(rng, 20_000), item, prose(rng, 20_000)])
    df = spark.createDataFrame([(1, long_text, 5, "f"), (2, None, 6, "g")], "doc_id long, text string, item_id int, f string")
    bench = spark.createDataFrame([(7, item, "x")], "item_id long, text string, doc_id string")
    assert [tuple(r) for r in contamination(df, bench).collect()] == [(1, 7, 0)]
    assert decontaminate(df, bench).columns == df.columns and decontaminate(df, bench).count() == 1


def test_short_items_match_brute_force():
    rng = random.Random(10)
    items = [prose(rng, 1)[: rng.randrange(1, 8)] for _ in range(30)] + [prose(rng, 2)[:7].strip() for _ in range(10)] + ["a", "a"]
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(150)] + ["", None, items[0], items[1] + "x"]
    index = QGramIndex.build([(i, normal(t)) for i, t in enumerate(items)])
    for t, found in zip(texts, search(index, index.table(), texts), strict=True):
        assert found == [(i, 0) for i, item in enumerate(items) if f" {normal(item)} " in f" {normal(t)} "]


def test_items_of_8_to_20_characters_match_brute_force():
    rng = random.Random(11)
    items = [prose(rng, 6)[: rng.randrange(8, 21)].strip() for _ in range(30)]
    items = [x for x in items if len(x) >= 8]
    texts = [" ".join([prose(rng, 9), edited(rng, rng.choice(items), rng.randrange(0, 3)), prose(rng, 9)]) for _ in range(80)]
    index = QGramIndex.build(list(enumerate(items)))
    for t, found in zip(texts, search(index, index.table(), texts), strict=True):
        want = {i: least_edits(item, normal(t)) for i, item in enumerate(items)}
        assert dict(found) == {i: e for i, e in want.items() if e <= index.budget[i]}


def test_items_of_any_length_and_null_ids(spark):
    items = ["Who is he?", "天気がいい", "今日はとても天気がいいですね", "why", "None has this id, long enough to be found", "ok go", "!?"]
    bench = spark.createDataFrame([(None if "None" in t else i, t) for i, t in enumerate(items)], "item_id long, text string")
    texts = ["So: who is HE then", "今日は天気がいいから", "昨日、今日はとても天気がいいですね。", "Why?", items[4], "whyever look gone", "plain words only"]
    df = docs(spark, texts)
    got = {(r.doc_id, r.item_id, r.edits) for r in contamination(df, bench).collect()}
    assert got == {(0, 0, 0), (1, 1, 0), (2, 1, 0), (2, 2, 0), (3, 3, 0), (4, None, 0)}
    assert sorted(r.doc_id for r in decontaminate(df, bench).collect()) == [5, 6]
