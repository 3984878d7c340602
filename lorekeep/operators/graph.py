"""GR-1 to GR-11: claim graph: resolution, expansion, neighbourhoods, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..scratch import discard, stored


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """GR-11, SET-1: (query_id, entity_key) of names that are keys or aliases."""
    direct = names.join(entities.select("entity_key"), F.col("name_key") == F.col("entity_key")).select("query_id", "entity_key")
    other = names.join(aliases, F.col("name_key") == F.col("alias_key")).select("query_id", "entity_key")
    return direct.unionByName(other).distinct()


def neighbours(seeds: DataFrame, claims: DataFrame) -> DataFrame:
    """JN-6, SET-2: both directions of the claims of each query's seeds."""
    s = seeds.select("query_id", F.col("entity_key").alias("seed"))
    out = claims.join(s, F.col("subject") == F.col("seed")).select("query_id", F.col("object").alias("entity_key"), "predicate", "confidence")
    back = claims.join(s, F.col("object") == F.col("seed")).select("query_id", F.col("subject").alias("entity_key"), "predicate", "confidence")
    return out.unionAll(back).filter("entity_key is not null")


def expand(seeds: DataFrame, claims: DataFrame, limit: int = 20) -> DataFrame:
    """GR-3, AG-1, TK-5, AG-2: (query_id, entity_key, weight); the limit is before the second maximum."""
    best = neighbours(seeds, claims).groupBy("query_id", "entity_key", "predicate").agg(F.max("confidence").alias("confidence"))
    w = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "entity_key", "predicate")
    top = best.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)
    weight = F.least(F.lit(vocab.GRAPH_MOST), T.lookup(vocab.GRAPH_WEIGHTS, F.col("predicate"), vocab.GRAPH_DEFAULT) * F.col("confidence"))
    return top.groupBy("query_id", "entity_key").agg(F.max(weight).alias("weight"))


def reached(seeds: DataFrame, edges: DataFrame, radius: int, directed: bool = False) -> DataFrame:
    """GR-4, GR-5: (node, hops) within ``radius`` (0 to 5) of the seeds (node).

    Edges are made distinct and stored once.  Each hop joins the last frontier
    with them and stores the next one, so plans stay short, lost executors
    cost one hop, and what was reached is never written again."""
    radius = max(0, min(5, radius))
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if not directed:
        e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = front = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    if not radius:
        return known
    e = stored(e.distinct(), "edges")
    for hop in range(1, radius + 1):
        new = front.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(known.select("node"), "node", "left_anti")
        front = stored(new.withColumn("hops", F.lit(hop)), "front")
        known = known.unionByName(front)
        if front.isEmpty():
            break
    discard(e)
    return known


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-4: edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def ego(start: Column, edges: DataFrame, radius: int = 2) -> DataFrame:
    """GR-5: directed, start matched without case."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return reached(nodes.filter(F.lower("node") == F.lower(start)), edges, radius, directed=True)


def expand_old(names: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-9: names, with their successors and predecessors (matched without case)."""
    low = names.select("query_id", F.col("name"), F.lower("name").alias("low"))
    ends = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionAll(edges.select(F.col("dst").alias("x"), F.col("src").alias("y")))
    hit = low.join(ends, F.col("low") == F.lower("x"))
    return low.select("query_id", "name").unionByName(hit.select("query_id", F.col("x").alias("name"))).unionByName(hit.select("query_id", F.col("y").alias("name"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """AG-20."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def compose(parts: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """SET-5, GR-10: union of graphs; later attributes win."""
    rest = [c for c in parts.columns if c not in (*keys, seq)]
    top = F.max_by(F.struct(*rest), F.col(seq)).alias("top")
    return parts.groupBy(*keys).agg(top).select(*keys, *[F.col("top")[c].alias(c) for c in rest])


def export(claims: DataFrame, entities: DataFrame, documents: DataFrame, candidates: bool = False, historical: bool = False) -> DataFrame:
    """GR-6, JN-9, PRJ-15: visible claims as (source, relation, target); a literal object is a node of its own."""
    status = ["explicit", "verified"] + ["candidate"] * candidates
    d = documents.select(F.col("memory_id").alias("evidence_memory_id"), "doc_status", "current_revision_id")
    seen = claims.filter(F.col("status").isin(status)).join(d, "evidence_memory_id")
    if not historical:
        seen = seen.filter("doc_status = 'active' and current_revision_id = evidence_revision_id")
    s = entities.select(F.col("entity_key").alias("subject"), F.col("canonical_name").alias("source"))
    o = entities.select(F.col("entity_key").alias("object"), F.col("canonical_name").alias("target"))
    joined = seen.join(s, "subject").join(o, "object", "left")
    return joined.select("claim_id", "source", F.col("predicate").alias("relation"), F.coalesce("target", F.concat(F.lit("Literal:"), F.col("claim_id").cast("string"))).alias("target"), "confidence", F.col("target").isNull().alias("literal"))


def evidenced(entities: DataFrame, mentions: DataFrame, claims: DataFrame, documents: DataFrame) -> DataFrame:
    """GR-7, JN-12: names of entities with a visible mention or claim: two semi-joins and a union for the OR."""
    d = documents.filter("doc_status = 'active'").select("memory_id", F.col("current_revision_id").alias("revision_id"))
    seen = mentions.join(d, ["memory_id", "revision_id"], "left_semi").select("entity_key")
    c = claims.filter(F.col("status").isin("explicit", "verified")).join(d, (F.col("evidence_memory_id") == d["memory_id"]) & (F.col("evidence_revision_id") == d["revision_id"]), "left_semi")
    ends = c.select(F.explode(F.array("subject", "object")).alias("entity_key"))
    return entities.join(seen.unionByName(ends).distinct(), "entity_key", "left_semi").select("canonical_name").distinct()


def relations(edges: DataFrame, name: Column) -> DataFrame:
    """GR-8, PRJ-16: one hop around a name: outgoing as they are, incoming inverted."""
    out, back = F.lower("src") == F.lower(name), F.lower("dst") == F.lower(name)
    kind = F.when(out, F.upper("relation")).otherwise(F.concat(F.lit("INVERSE_"), F.upper("relation")))
    return edges.filter(out | back).select(kind.alias("relation"), F.when(out, F.col("dst")).otherwise(F.col("src")).alias("other"))


def project(notes: DataFrame) -> dict[str, DataFrame]:
    """GR-1: entities, mentions and claims of parsed notes (memory_id, title,
    memory_type, aliases, entities, related_to, relationships, body, occurred, created, seq)."""
    key = T.entity_key
    subject = key(F.col("title"))
    named = notes.select("memory_id", "seq", F.explode(F.concat(F.array(F.struct(F.col("title").alias("name"), F.col("memory_type").alias("kind"))), F.transform("entities", lambda e: F.struct(T.clean_link(e).alias("name"), F.lit("concept").alias("kind"))), F.transform(T.links(F.col("body")), lambda e: F.struct(e.alias("name"), F.lit("concept").alias("kind"))))).alias("e"))
    named = named.select("memory_id", "seq", "e.name", "e.kind").filter("name <> ''")
    entities = named.groupBy(key(F.col("name")).alias("entity_key")).agg(F.min_by("name", F.struct("seq", "name")).alias("canonical_name"), F.min_by("kind", F.struct("seq", "name")).alias("entity_type"))
    mentions = notes.select("memory_id", F.explode(T.links(F.col("body"))).alias("surface")).withColumn("entity_key", key(F.col("surface")))
    explicit = F.transform("related_to", lambda x: F.struct(F.lit("related_to").alias("predicate"), T.clean_link(x).alias("target"), F.lit("explicit").alias("status")))
    claims = notes.select("memory_id", subject.alias("subject"), F.coalesce("occurred", "created").alias("valid_from"), F.explode(F.concat(explicit, "relationships")).alias("r"))
    claims = claims.select("memory_id", "subject", "r.predicate", key(F.col("r.target")).alias("object"), "r.status", F.when(F.col("r.status").isin("explicit", "verified"), 1.0).otherwise(0.5).alias("confidence"), "valid_from").filter("object <> ''")
    return {"entities": entities, "mentions": mentions, "claims": claims}


def prose(docs: DataFrame, text_col: str = "text", name_col: str = "source_file") -> DataFrame:
    """GR-2, SC-25: edges stated in prose around links: (src, dst, relation).

    A document references each linked entity; words before a link state a
    relation from the sentence's first other entity, or else the document.
    Of several relations between two nodes the last stated wins."""
    doc = F.concat(F.lit("DOC:"), F.col(name_col))
    parts = F.split(F.regexp_replace(F.col(text_col), r"([.!?\n])\s+", "$1\u0001"), "\u0001")
    each = docs.select(doc.alias("doc"), F.posexplode(parts).alias("at", "s")).withColumn("names", T.links(F.col("s"))).filter(F.size("names") > 0)

    def stated(rule: int, relation: str, names: Column) -> Column:
        as_edge = lambda x, i: F.struct(F.lit(rule).alias("rule"), i.alias("i"), F.lit(relation).alias("relation"), T.clean_link(x).alias("dst"))
        return F.transform(names, as_edge)

    rules = [stated(n, r, F.regexp_extract_all("s", F.lit(rf"(?i)(?:{'|'.join(words)})\s+\[\[(.*?)\]\]"), F.lit(1))) for n, (r, words) in enumerate(vocab.RELATION_WORDS.items(), 1)]
    # one pass: what a sentence states by all rules is one array
    edges = each.select("doc", "at", "names", F.explode(F.concat(stated(0, "references", F.col("names")), *rules)).alias("e")).filter("e.dst <> ''")
    first = F.element_at("names", 1)
    src = F.when((F.col("e.rule") > 0) & (F.size("names") > 1) & (first != F.col("e.dst")), first).otherwise(F.col("doc"))
    edges = edges.select("doc", "at", "e.rule", "e.i", src.alias("src"), "e.dst", "e.relation")
    return edges.groupBy("src", "dst").agg(F.max_by("relation", F.struct("doc", "at", "rule", "i")).alias("relation"))
