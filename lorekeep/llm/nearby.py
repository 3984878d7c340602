"""Near-dedup by BagMinHash over word shingles, with exact verification.

Signatures.  A text is a multiset of five-word shingles.  Each shingle owns
Poisson processes over its weight axis, cut at the discretised weights 0, 1,
2, 4, 8, ...: the process of [2^(j-1), 2^j) has that rate, and every point has
a time, a register and a cell of its interval (the leaves of the binary
hierarchy).  A text of weight w sees the points whose cell is below w, and a
register keeps its earliest point.  Two texts agree in a register with
probability equal to their weighted Jaccard similarity.  Points are made in
order of time and only until they are later than all registers of the text,
so a text costs about its shingles plus m log m.

Search.  Equal texts collapse first.  Signatures are cut into bands; texts
that agree in a band are candidates and are compared with a pivot of their
bucket (the most central member), not with each other.  Verified links make
components, so a family of near copies costs about one comparison a member.

The rest.  Buckets whose members are then not all in one component are open.
Links between their members are found by prefixes: with shingles in one order,
rare ones first, two texts that are similar enough must share one of the first
few of each.  Members that share one, are in different components and pass the
bounds of size, place and bitmap (each bit of one that the other lacks is a
shingle that they don't share) are compared.  That is exact for all pairs of
such members, whatever the buckets.  Texts with more shingles of their own than
the lesser one's prefix are never paired over common boilerplate; texts just
below the similarity, with fewer of their own, still meet pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACES, batches_of, by_size, discard, joined_back, split_join, stored
from .repeats import mixed, window_hashes, word_hashes

SHINGLE, SIMILAR = 5, 0.8
#: 24 bands of 4: a pair at 0.8 is missed with probability 3e-6.
BANDS, ROWS = 24, 4
#: Bits of a text's bitmap; from some thousand shingles on, it fills and bounds little.
BITS = 2048
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words, sorted; a shorter text is one shingle."""
    h = word_hashes(text)
    return np.sort(window_hashes(h, min(k, len(h)))) if len(h) else h


def numbered(sorted_hashes: np.ndarray) -> np.ndarray:
    """Occurrences made distinct (hash and number), sorted: multiset overlap becomes set overlap."""
    n = len(sorted_hashes)
    new = np.append(True, sorted_hashes[1:] != sorted_hashes[:-1])[:n]
    number = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.arange(0)
    return np.sort(mixed(sorted_hashes + number.astype(np.uint64) * _GOLD))


def text_key(text: str | None) -> bytes:
    return hashlib.md5(b" ".join((text or "").encode("utf-8", "surrogatepass").split())).digest()


def text_key_column(text: Column) -> Column:
    """``text_key`` by Spark's own functions."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))))


def bag_minhash(bags: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (a point's identity for each register) of multisets given as sorted hashes."""
    times, points = np.full(len(bags) * m, np.inf), np.zeros(len(bags) * m, np.uint64)
    parts = []
    for d, bag in enumerate(bags):
        if len(bag):
            own, w = np.unique(bag, return_counts=True)
            parts.append((np.full(len(own), d), own, w))
    if not parts:
        return points.reshape(len(bags), m)
    doc, own, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    levels = [(doc, own, w, np.zeros(len(doc)), np.ones(len(doc)))]
    j = 1
    while (more := (1 << (j - 1)) < w).any():  # [2^(j-1), 2^j) is needed from weight 2^(j-1) + 1 on
        low = float(1 << (j - 1))
        levels.append((doc[more], mixed(own[more] + np.uint64((j * int(_GOLD)) % (1 << 64))), w[more], np.full(more.sum(), low), np.full(more.sum(), low)))
        j += 1
    doc, state, w, low, rate = (np.concatenate(x) for x in zip(*levels, strict=True))
    t = np.zeros(len(doc))
    while len(doc):
        state = mixed(state + _GOLD)
        t = t - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        place = mixed(state ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        register = ((place >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        cell = low + np.floor((place & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate)
        at = doc * m + register.astype(np.int64)
        hit = np.flatnonzero((cell < w) & (t < times[at]))
        hit = hit[np.argsort(-t[hit], kind="stable")]  # of several, the earliest is written last
        times[at[hit]], points[at[hit]] = t[hit], state[hit]
        on = t < times.reshape(-1, m).max(axis=1)[doc]
        doc, state, w, low, rate, t = doc[on], state[on], w[on], low[on], rate[on], t[on]
    return points.reshape(len(bags), m)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1)
    out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        cut, sizes = [], []
        for begin, end in by_size(texts):
            bags = [shingles(t, k) for t in texts[begin:end]]
            hashes = band_hashes(bag_minhash(bags, bands * rows), bands)
            cut += [h.tolist() if len(s) else [] for h, s in zip(hashes, bags, strict=True)]
            sizes += [len(s) for s in bags]
        cols = [b.column("id"), pa.array([text_key(t) for t in texts], pa.binary()), pa.array(sizes, pa.int64()), pa.array(cut, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["id", "key", "n", "bands"])


def _bags(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rep, bag, bits = [], [], []
        for r, key, text in zip(b.column("rep").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
            if text_key(text) == key:  # rows that repeat an id may have other texts
                own = numbered(shingles(text, k))
                rep.append(r)
                bag.append(own.tobytes())
                bits.append(bitmap(own).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(bag, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], names=["rep", "bag", "bits"])


def bitmap(bag: np.ndarray) -> np.ndarray:
    on = np.zeros(BITS, np.uint8)
    on[(bag >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(on, bitorder="little").view(np.int64)


def may_overlap(na: Column, nb: Column, a: Column, b: Column, similar: float) -> Column:
    """False only if the bitmaps show that fewer shingles are shared than the similarity needs."""
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda acc, v: acc + v)
    need = (na + nb) * (similar / (1 + similar)) - 1e-6
    return (na - lacks(a, b) >= need) & (nb - lacks(b, a) >= need)


def _overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        s = np.sort(np.concatenate([u, v]))
        both = int((s[1:] == s[:-1]).sum())
        out.append(both / (len(u) + len(v) - both) if len(u) + len(v) else 1.0)
    return pd.Series(out, dtype=float)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b).

    Alternating large and small stars: each step is a partial aggregate and a
    join on the node, and a stored table.  Nothing goes to the driver but counts."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = e.filter("a <> b")
    before, last = None, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        made = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("s"))
        now = stored(made.select("s.a", "s.b").filter("a <> b").distinct(), "stars")
        if last is not None:
            discard(last)
        last = now
        sum_ = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sum_ == before:
            labels = now.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("label"))
            out = stored(nodes.join(labels, F.col("node") == F.col("u"), "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
            discard(e, now)
            return out
        before = sum_


def prefixes(size: Column, similar: float) -> tuple[Column, Column]:
    """How many of a text's first shingles another one must meet if it is at least as large, and at any size."""
    first = lambda share: size - F.ceil(size * share - 1e-6) + 1
    return first(2 * similar / (1 + similar)), first(similar)


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, bag) -> (rep, s): a row for each numbered shingle."""
    for b in batches:
        bags = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("bag")]
        sizes = np.array([len(x) for x in bags])
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + 1, 200_000)[1:], "right").tolist()
        rep = b.column("rep").to_numpy()
        for i, j in zip([0, *cuts], [*cuts, len(bags)], strict=True):
            if i < j:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rep[i:j], sizes[i:j])), pa.array(np.concatenate(bags[i:j]))], names=["rep", "s"])


def may_pair(pairs: DataFrame, bags: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, na, b, nb) whose bitmaps don't rule them out: (a, b)."""
    sketch = lambda x: bags.select(F.col("rep").alias(f"r{x}"), F.col("bits").alias(f"bits{x}"))
    pairs = stored(pairs, "pairs")
    both = split_join(pairs, sketch("2"), "b", "r2", "a").join(sketch("1"), F.col("a") == F.col("r1"))
    return both.filter(may_overlap(F.col("na"), F.col("nb"), F.col("bits1"), F.col("bits2"), similar)).select("a", "b")


def open_pairs(members: DataFrame, bags: DataFrame, similar: float) -> DataFrame:
    """(a, b): pairs of members (rep, n, label) of different labels that may be similar.

    Exact: a pair that is similar shares a shingle in both prefixes, and no
    bound drops it.  Shingles of one text alone come first in its order and
    meet nothing, so only shared ones are joined.  Of the members that share a
    shingle, those of the label that has most of them are not paired with
    each other: one of the two is always of the rest.
    """
    own = bags.join(members.select(F.col("rep").alias("r"), "n", "label"), F.col("rep") == F.col("r")).drop("r")
    rows = own.select("rep", "bag").mapInArrow(_shingle_rows, "rep long, s long")
    shared = rows.groupBy(F.col("s").alias("t")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    order = F.sort_array(F.collect_list(F.struct("c", "s")))
    first = rows.join(shared, F.col("s") == F.col("t")).groupBy(F.col("rep").alias("r")).agg(order.alias("first"))
    have = own.select("rep", "n", "label").join(first, F.col("rep") == F.col("r"))
    index, probe = prefixes(F.col("n"), similar)
    alone = F.col("n") - F.size("first")
    each = have.filter(alone < probe).select("rep", "n", "label", index.alias("index"), alone.alias("alone"), F.posexplode(F.slice("first", F.lit(1), (probe - alone).cast("int"))).alias("i", "x"))
    each = stored(each.select("rep", "n", "label", "index", (F.col("alone") + F.col("i")).alias("at"), F.col("x.s").alias("s")), "prefixes")
    labels = each.groupBy("s", "label").agg(F.count(F.lit(1)).alias("c")).groupBy(F.col("s").alias("t"))
    major = labels.agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    both = each.join(major, F.col("s") == F.col("t")).withColumn("most", F.col("label") == F.col("major"))
    side = lambda d, x: d.select(*[F.col(c).alias(f"{c}{x}") for c in ("s", "rep", "n", "label", "at", "most")])
    # of two texts the lesser (by size, then by number) meets the other within its index prefix:
    # shingles beyond it are on one side of the join only
    meets = F.when(F.col("most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    x, y = side(both.filter("at < index").withColumn("most", F.explode(meets)), "1"), side(both, "2")
    less = F.struct("n1", "rep1") < F.struct("n2", "rep2")
    need = F.ceil((F.col("n1") + F.col("n2")) * (similar / (1 + similar)) - 1e-6)
    bound = (F.col("n1") - F.col("at1") >= need) & (F.col("n2") - F.col("at2") >= need)
    near = (F.col("s1") == F.col("s2")) & (F.col("most1") == F.col("most2")) & (F.col("label1") != F.col("label2")) & less & bound
    pairs = x.join(y, near).select(F.col("rep1").alias("a"), F.col("n1").alias("na"), F.col("rep2").alias("b"), F.col("n2").alias("nb"))
    return may_pair(pairs.distinct(), bags, similar)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every row of docs with its class of near copies.

    Returns id, ``class_id`` (least id of the class), ``class_size``, ``kept``
    (one row a class), and ``text_key``.  Classes are the connected components
    of texts whose multisets of ``k``-word shingles have a Jaccard similarity
    of at least ``similar``; texts with the same words are always together.

    Null texts have no words; texts without words are one class of exact
    copies and link to nothing else; texts of fewer than ``k`` words are one
    shingle; long texts count whole.  Null ids sort last; ids of any type.
    Repeated rows are copies of each other.  Ties have the least row kept.
    Other columns are not read, whatever their names.  Empty table: no rows.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    signed = source.mapInArrow(lambda it: _signed(it, bands, rows, k), f"id {kind}, key binary, n long, bands array<long>")
    with batches_of(docs.sparkSession, 256):
        signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    least = stored(signed.groupBy(F.col("key").alias("g")).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "least")
    total = signed.count()
    members = stored(joined_back(signed.select("row", "id", "key"), least, "key", "g", "copies", total).drop("g", "copies"), "members")
    reps = signed.join(least.select("rep"), F.col("row") == F.col("rep"), "left_semi")

    # buckets of at least two texts; a member is central if its buckets are large
    banded = reps.select(F.col("row").alias("rep"), "n", F.explode("bands").alias("bucket"))
    full = banded.groupBy(F.col("bucket").alias("b")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = stored(banded.join(full, F.col("bucket") == F.col("b")).drop("b"), "shared")
    central = shared.groupBy(F.col("rep").alias("r")).agg(F.sum("c").alias("w"))
    weighed = shared.join(central, F.col("rep") == F.col("r")).drop("r")
    first = F.max(F.struct("w", (-F.col("rep")).alias("r"), "n")).alias("p")
    pivots = weighed.groupBy(F.col("bucket").alias("b")).agg(first).select("b", (-F.col("p.r")).alias("pivot"), F.col("p.n").alias("pn"))
    buckets = stored(weighed.join(pivots, F.col("bucket") == F.col("b")).drop("b"), "buckets")
    alike = lambda a, b: F.least(a, b) >= F.greatest(a, b) * similar  # noqa: E731  J is at most the ratio of sizes

    wanted = buckets.select(F.col("rep").alias("w")).distinct()
    wanted = signed.select("row", "id", "key").join(wanted, F.col("row") == F.col("w")).select(F.col("row").alias("rep"), F.col("id").alias("wid"), "key")
    same = F.col("id").eqNullSafe(F.col("wid"))
    if not signed.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
        same &= text_key_column(F.col("text")) == F.col("key")  # rows of one id meet those with their text only
    texts = source.join(wanted, same).select("rep", "key", "text")
    bags = texts.mapInArrow(lambda it: _bags(it, k), "rep long, bag binary, bits array<long>")
    with batches_of(docs.sparkSession, 256):
        bags = stored(bags.dropDuplicates(["rep"]), "bags")
    overlap = F.pandas_udf(_overlap, "double")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = bags.select(F.col("rep").alias("ra"), F.col("bag").alias("ba")), bags.select(F.col("rep").alias("rb"), F.col("bag").alias("bb"))
        pairs = stored(pairs, "maybe")
        both = split_join(pairs, two, "b", "rb", "a").join(one, F.col("a") == F.col("ra"))
        return stored(both.select("a", "b", overlap("ba", "bb").alias("j")).filter(F.col("j") >= similar).select("a", "b"), "links")

    star = buckets.filter((F.col("rep") != F.col("pivot")) & alike(F.col("n"), F.col("pn")))
    pairs = may_pair(star.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pivot").alias("b"), F.col("pn").alias("nb")).distinct(), bags, similar)
    links = verified(pairs)
    labels = components(links)
    # buckets of three or more whose members are in several components; those of two are decided
    at = buckets.filter("c > 2").join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep"))
    mixed_ = at.groupBy(F.col("bucket").alias("b")).agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 <> l2")
    members_ = stored(at.join(mixed_, F.col("bucket") == F.col("b"), "left_semi").select("rep", "n", "label").distinct(), "open")
    new = verified(open_pairs(members_, bags, similar))
    if not new.isEmpty():
        labels = components(links.unionByName(new))

    named = stored(least.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("rep").alias("r"), "copies", F.coalesce("label", "rep").alias("class")), "named")
    labelled = stored(joined_back(members, named, "rep", "r", "copies", total).select("row", "id", "key", "class"), "labelled")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    classes = stored(labelled.groupBy(F.col("class").alias("c")).agg(first, F.count(F.lit(1)).alias("class_size")), "classes")
    discard(signed, least, members, named, shared, buckets, bags, members_, new)
    return joined_back(labelled, classes, "class", "c", "class_size", total).select(
        F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("key").alias("text_key")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that stay, one a class, with their columns as they are."""
    groups = stored(near_groups(docs, id_col, text_col, **params).select(F.col(id_col).alias("i"), F.col("text_key").alias("k"), "kept"), "kept")
    repeated = groups.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    kept = groups.filter("kept").select("i", "k")
    cols, names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = dict(zip(cols, names, strict=True))
    mine = plain.withColumn("key", text_key_column(F.col(at[text_col])))
    stay = mine.join(kept, F.col(at[id_col]).eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi")
    if repeated:  # rows that repeat an id and a text: one of them
        one = Window.partitionBy(at[id_col], "key").orderBy(F.xxhash64(*names))
        stay = stay.withColumn("number", F.row_number().over(one)).filter("number = 1")
    return stay.select(*[F.col(n).alias(c) for c, n in at.items()])
