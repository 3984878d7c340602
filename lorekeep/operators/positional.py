"""SC-5, SC-6, RET-1: positional postings, cover density, and the web search syntax over them.

Postings keep where a lexeme stands in its chunk.  Cover density and phrases
are folds and joins over these places; texts are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import DENSITY, DENSITY_CAP, STRICT

#: A part of a web query: an optional minus, and a quoted phrase or a run of other characters than spaces.
ITEM = r'(-?"[^"]*"?|[^\s"]+)'


def positions(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", analyzer=T.tokens, queries: DataFrame | None = None) -> DataFrame:
    """Postings (chunk_id, lexeme, places): the sorted places (from 0) of each lexeme.

    With ``queries`` (query_id, text), only what the batch asks for is kept,
    before anything moves.  A chunk's lexemes are grouped within their chunk,
    so no list is longer than its text."""
    each = chunks.select(F.col(id_col).alias("chunk_id"), F.posexplode(analyzer(F.col(text_col))).alias("place", "lexeme"))
    if queries is not None:
        asked = queries.select(F.explode(T.lexemes(F.col("text"))).alias("lexeme")).distinct()
        each = each.join(asked, "lexeme", "left_semi")
    return each.groupBy("chunk_id", "lexeme").agg(F.sort_array(F.collect_list("place")).alias("places"))


def cover_densities(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, chunk_id, shared, n, covers, density) of chunks that share a lexeme with a query.

    A cover is a shortest run of a chunk that holds all lexemes which query
    and chunk share: none lies in another.  One with e places of them and w
    other words adds 0.1 / (1 + w).  So one shared lexeme counts 0.1 at each
    of its places, several count the more the closer they stand.  ``density``
    is the sum, uncapped.

    A fold over the merged places: for each lexeme the last place so far; when
    the least of them moves, the run from there to here is a cover.
    """
    terms = queries.select("query_id", T.lexemes(F.col("text")).alias("own")).select("query_id", F.size("own").alias("n"), F.explode("own").alias("lexeme"))
    met = terms.join(postings, "lexeme").groupBy("query_id", "chunk_id").agg(F.max("n").alias("n"), F.collect_list("places").alias("lists"))
    merged = F.sort_array(F.flatten(F.transform("lists", lambda p, i: F.transform(p, lambda x: F.struct(x.alias("place"), i.alias("term"))))))
    start = F.struct(
        F.array_repeat(F.lit(-1), F.size("lists")).alias("at"),  # last place of each term
        F.array_repeat(F.lit(-1), F.size("lists")).alias("rank"),  # its number among the merged places
        F.lit(0).alias("seen"), F.lit(-1).alias("begun"), F.lit(0).alias("covers"), F.lit(0.0).alias("density"),
    )

    def step(s, x):
        at = F.transform(s["at"], lambda v, i: F.when(i == x["term"], x["place"]).otherwise(v))
        rank = F.transform(s["rank"], lambda v, i: F.when(i == x["term"], s["seen"]).otherwise(v))
        first, own = F.array_min(at), s["seen"] - F.array_min(rank) + 1
        new = first > s["begun"]
        others = x["place"] - first + 1 - own
        return F.struct(
            at.alias("at"), rank.alias("rank"), (s["seen"] + 1).alias("seen"), F.when(new, first).otherwise(s["begun"]).alias("begun"),
            (s["covers"] + new.cast("int")).alias("covers"), (s["density"] + F.when(new, F.lit(DENSITY) / (1 + others)).otherwise(0.0)).alias("density"),
        )

    folded = met.select("query_id", "chunk_id", F.size("lists").alias("shared"), "n", F.aggregate(merged, start, step).alias("s"))
    return folded.select("query_id", "chunk_id", "shared", "n", F.col("s.covers").alias("covers"), F.col("s.density").alias("density"))


def parsed(queries: DataFrame) -> DataFrame:
    """The items of web queries: (query_id, alternative, item, negated, lexemes).

    Words and quoted phrases must all be there; a minus excludes the next word
    or phrase; ``or`` between them begins an alternative (it binds less than
    the rest).  An item of several lexemes, as a phrase or a hyphenated word,
    asks for them one after the other.  Items without a lexeme are left out.
    An unclosed quote runs to the end; ``or`` in quotes is a word.
    """
    found = queries.select("query_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ITEM), F.lit(1)).alias("found"))
    either = lambda x: F.lower(x) == "or"
    each = found.select("query_id", F.posexplode(F.transform("found", lambda x, i: F.struct(x.alias("raw"), F.size(F.filter(F.slice("found", 1, i), either)).alias("alternative")))).alias("item", "x"))
    raw = F.col("x.raw")
    negated = raw.startswith("-") & (F.length(raw) > 1)
    items = each.filter(~either(raw)).select("query_id", "x.alternative", "item", negated.alias("negated"), T.tokens(raw).alias("lexemes"))
    return items.filter(F.size("lexemes") > 0)


def item_matches(items: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, alternative, item, chunk_id) where an item's lexemes stand one after the other.

    An equi-join on the lexeme; each place less the lexeme's offset is where
    the run would begin, and a run is there if all of its lexemes agree."""
    single, runs = items.filter(F.size("lexemes") == 1), items.filter(F.size("lexemes") > 1)
    one = single.select("query_id", "alternative", "item", F.get("lexemes", F.lit(0)).alias("lexeme")).join(postings.select("lexeme", "chunk_id"), "lexeme")
    parts = runs.select("query_id", "alternative", "item", F.size("lexemes").alias("m"), F.posexplode("lexemes").alias("offset", "lexeme"))
    begun = parts.join(postings, "lexeme").select("query_id", "alternative", "item", "chunk_id", "m", "offset", F.explode("places").alias("place"))
    whole = begun.groupBy("query_id", "alternative", "item", "chunk_id", (F.col("place") - F.col("offset")).alias("begin")).agg(F.count(F.lit(1)).alias("held"), F.max("m").alias("m")).filter("held = m")
    key = ["query_id", "alternative", "item", "chunk_id"]
    return one.select(*key).unionByName(whole.select(*key).distinct())


def web_matches(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of chunks that satisfy a web query (see ``parsed``).

    Candidates are the chunks that hold a lexeme of the query, also an
    excluded one; a query that only excludes is satisfied by those of them
    that lack the excluded runs.  Excluded items are anti-joins, required
    ones are counted.
    """
    items = parsed(queries)
    hits = item_matches(items, postings)
    sides = items.groupBy("query_id", "alternative").agg(F.count_if(~F.col("negated")).alias("asked"))
    flagged = hits.join(items.select("query_id", "alternative", "item", "negated"), ["query_id", "alternative", "item"])
    met = flagged.groupBy("query_id", "alternative", "chunk_id").agg(F.count_if(~F.col("negated")).alias("met"), F.count_if("negated").alias("broken"))
    required = met.join(sides.filter("asked > 0"), ["query_id", "alternative"]).filter("met = asked AND broken = 0").select("query_id", "chunk_id")
    terms = items.select("query_id", F.explode("lexemes").alias("lexeme")).distinct()
    near = terms.join(postings.select("lexeme", "chunk_id"), "lexeme").select("query_id", "chunk_id").distinct()
    free = near.join(sides.filter("asked = 0"), "query_id").join(met.filter("broken > 0"), ["query_id", "alternative", "chunk_id"], "left_anti").select("query_id", "chunk_id")
    return required.unionByName(free).distinct()


def web_search_matches(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """RET-1 with the web syntax: (query_id, chunk_id, coverage, strict, rank, shared, n).

    ``strict`` says that the chunk satisfies the query as written; the rank is
    coverage, 0.25 for it, and cover density up to 0.25."""
    dense = cover_densities(queries, postings)
    strict = web_matches(queries, postings).withColumn("_strict", F.lit(True))
    both = dense.join(strict, ["query_id", "chunk_id"], "left").withColumn("strict", F.coalesce("_strict", F.lit(False)))
    coverage = F.col("shared") / F.greatest(F.col("n"), F.lit(1))
    rank = coverage + F.when(F.col("strict"), STRICT).otherwise(0.0) + F.least(F.lit(DENSITY_CAP), F.col("density"))
    return both.select("query_id", "chunk_id", coverage.alias("coverage"), "strict", rank.alias("rank"), F.col("shared").cast("long").alias("shared"), "n")
