"""Change feeds and front matter against plain versions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.sources import vault


def test_changes(spark):
    listing = lambda *rows: spark.createDataFrame(list(rows) or [("x", "y")], "path string, content_hash string").filter(F.lit(bool(rows)))
    before = listing(("a.md", "1"), ("b.md", "2"), ("c.md", "3"), ("d.md", "4"), ("e.md", "4"), ("f.txt", "5"), (".git/g.md", "6"))
    after = listing(("a.md", "1"), ("b.md", "x"), ("n/c.md", "3"), ("n/d.md", "4"), ("new.md", "9"), ("f.txt", "7"), (".git/g.md", "8"))
    got = sorted(map(tuple, vault.changes(before, after).collect()))
    assert got == [("b.md", "modified", 0), ("c.md", "moved_from", 1), ("d.md", "moved_from", 1), ("e.md", "deleted", 0), ("n/c.md", "moved_to", 0), ("n/d.md", "moved_to", 0), ("new.md", "created", 0)]
    assert vault.changes(before, before).count() == 0
    assert {r.event_type for r in vault.changes(listing(), after).collect()} == {"created"}


def test_front_matter_as_readers_see_it(spark):
    texts = ["---\na: 1\n---\nbody \n", "x\n---\na: 1\n---  rest ", "---\na: 1\n---", "---\n\n---\n b\n---\nc", "---\n---\nx", "no front matter", "", "---\na\nb\n---\n\n"]

    def plain(text, reader):
        if reader == "chunker":
            m = re.search(r"^---\n(.*?)\n---", text, re.S | re.M)
            return (m[1], text[m.end() :].strip()) if m else (None, text)
        m = re.match(r"^---\n(.*?)\n---\n", text, re.S)
        return (None, text) if not m else (m[1], text[m.end() :] if reader == "quality" else text[m.end() :].strip())

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for reader in T.FRONT_MATTER:
        got = {r.id: (r.head, r.body) for r in df.select("id", T.front_matter(F.col("text"), reader).alias("m")).select("id", "m.*").collect()}
        assert got == {i: plain(t, reader) for i, t in enumerate(texts)}, reader
