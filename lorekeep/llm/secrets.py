"""Secret scan with corpus-wide ownership frequency.

Candidate credentials are found by pattern, hashed, and counted over the whole
corpus by distinct owner and repository.  A value that many owners share is a
copied example; a value that one owner alone has is live-looking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import joined_back, stored

# The patterns of the base kinds, in the order that ranks kinds
# at the same start.  Keyword letters are ASCII in either case.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"  # a run of 32 or more is a whole run
#: Wider candidates: long tokens with a digit and a letter, whatever stands before them.
TOKEN = r"([A-Za-z0-9_-]{20,})"
KINDS = ("assign", "access", "hex", "live")
#: A value is live-looking if it has at most so many owners and repositories.
MAX_OWNERS, MAX_REPOS = 1, 2

#: Matches of a text that are summed in one piece.
PIECE = 64

_FOUND = "array<struct<start:int,end:int,vstart:int,value:string>>"
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def matches(text: Column, pattern: str, least: int) -> Column:
    """Leftmost matches of pattern that do not overlap: where they start and end
    (code points, end exclusive) and group 1, if it has ``least`` characters.

    Spark's functions give matched strings, not offsets.  ``split`` gives the
    text between matches, so offsets are running sums of both lengths.  They
    are made in pieces of PIECE matches, so that no array grows match by match
    over a text that is full of them.
    """
    whole, group = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    both = F.zip_with(whole, group, lambda w, g: F.struct(F.length(w).alias("n"), g.alias("value")))
    pieces = F.zip_with(both, F.split(text, pattern, -1), lambda x, gap: F.struct(F.length(gap).alias("gap"), x["n"].alias("n"), x["value"].alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        hit = F.struct(start.alias("start"), end.alias("end"), (end - F.length(x["value"])).alias("vstart"), x["value"].alias("value"))
        out = F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        return F.struct(F.coalesce(end, start).cast("int").alias("at"), out.cast(_FOUND).alias("out"))

    length = lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PIECE).cast("int")), lambda i: F.slice(pieces, i * PIECE + 1, F.lit(PIECE)))
    ends = F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + length(x))),
        F.array(F.lit(0)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )
    start = lambda at: F.struct(at.alias("at"), F.array().cast(_FOUND).alias("out"))
    found = F.zip_with(blocks, F.slice(ends, F.lit(1), F.size(ends) - 1), lambda b, at: F.aggregate(b, start(at), step, lambda acc: acc["out"]))
    return F.when(text.rlike(pattern), F.flatten(found)).otherwise(F.array().cast(_FOUND))


def joined(spans: Column) -> Column:
    """kind:start:end of spans (start, rank, end), sorted, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row for each row of docs: id, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans``, ``n_live``, ``n_copied``.

    ``spans`` has all base spans and, as kind ``live``, the value of every
    candidate (a base value, or a long token with digits and letters) that is
    owner-specific in the whole corpus.  ``n_copied`` counts the candidates
    that several owners share.

    Texts are read once; what is found is stored and counted from there.
    Value counts are aggregated by (value, owner, repository) before they
    move, so a value in a third of all rows collapses early.  Null text is
    empty; null owner or repository counts as one of its own.  Repeated rows
    are scanned each, of whatever length their texts are; ids of any type;
    other columns are not read, whatever their names.  Empty table: no rows.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    repo = F.concat_ws("\x01", *[F.coalesce(docs[c].cast("string"), F.lit("\x02")) for c in repo_cols])
    owner = F.coalesce(docs[owner_col].cast("string"), F.lit("\x02"))
    rows = docs.select(docs[id_col].alias("id"), owner.alias("owner"), repo.alias("repo"), text.alias("t"))
    rows = rows.select(
        "id", "owner", "repo",
        matches(F.col("t"), ASSIGN, 8).alias("a"), matches(F.col("t"), ACCESS, 16).alias("k"), matches(F.col("t"), HEX, 32).alias("x"),
        F.when(F.col("t").rlike(r"[A-Za-z0-9_-]{20}"), matches(F.col("t"), TOKEN, 20)).otherwise(F.array().cast(_FOUND)).alias("w"),
    )
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    value = lambda m: F.struct(m["vstart"].alias("start"), m["end"].alias("end"), F.unhex(F.md5(m["value"])).alias("hash"))
    wide = F.filter("w", lambda m: mixed(m["value"]))
    as_spans = lambda c, rank: F.transform(c, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    found = stored(rows.select(
        "id", "owner", "repo", F.monotonically_increasing_id().alias("row"),
        *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("x", "n_hex"))],
        F.concat(as_spans("a", 0), as_spans("k", 1), as_spans("x", 2)).cast(_SPANS).alias("base"),
        F.array_distinct(F.transform(F.concat("a", "k", "x", wide), value)).alias("candidates"),
    ), "secrets")
    each = found.filter(F.size("candidates") > 0).select("row", "owner", "repo", F.explode("candidates").alias("c")).select("row", "owner", "repo", "c.start", "c.end", "c.hash")
    owned = each.select("hash", "owner", "repo").distinct().groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count(F.lit(1)).alias("repos"))
    uses = each.groupBy("hash").agg(F.count(F.lit(1)).alias("uses"))
    owned = owned.join(uses, "hash").select(F.col("hash").alias("h"), "uses", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("live"))
    owned = stored(owned, "values")
    total = owned.agg(F.sum("uses")).first()[0] or 0
    judged = joined_back(each, owned, "hash", "h", "uses", total).groupBy("row").agg(
        F.collect_set(F.when(F.col("live"), F.struct("start", F.lit(3).alias("rank"), "end"))).cast(_SPANS).alias("added"),
        F.sum(F.when(F.col("live"), 0).otherwise(1)).cast("long").alias("n_copied"),
    )
    out = found.join(judged.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    added = F.coalesce("added", F.array().cast(_SPANS))
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex",
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", added)).alias("spans"),
        F.size(added).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
