"""The claim graph: parts, suppliers, nations and regions are entities, line items are claims, pages are linked prose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from .base import Tables, query

CLAIMS = """c AS (SELECT 'p' || l_partkey AS subject, 's' || l_suppkey AS object, CASE l_returnflag WHEN 'A' THEN 'fixes' WHEN 'N' THEN 'depends_on' ELSE 'mentions' END AS predicate,
  l_discount * 10 AS confidence, l_orderkey AS evidence, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS claim_id, CASE l_linestatus WHEN 'F' THEN 'explicit' ELSE 'candidate' END AS status FROM lineitem)"""
EDGES = """ed AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in' AS relation FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'of' FROM supplier
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'makes' FROM lineitem)"""


def name(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def claims_of(t: Tables) -> DataFrame:
    rel = F.when(F.col("l_returnflag") == "A", "fixes").when(F.col("l_returnflag") == "N", "depends_on").otherwise("mentions")
    return t.lineitem.select(
        name("p", "l_partkey").alias("subject"), name("s", "l_suppkey").alias("object"), rel.alias("predicate"), (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_orderkey").alias("evidence_memory_id"), F.col("l_orderkey").alias("evidence_revision_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        F.when(F.col("l_linestatus") == "F", "explicit").otherwise("candidate").alias("status"),
    )


def edges_of(t: Tables) -> DataFrame:
    made = t.lineitem.select(name("s", "l_suppkey").alias("src"), name("p", "l_partkey").alias("dst")).distinct()
    return (
        t.nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit("in").alias("relation"))
        .unionAll(t.supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("of").alias("relation")))
        .unionAll(made.withColumn("relation", F.lit("makes")))
    )


def documents_of(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("memory_id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("archived").alias("doc_status"), F.col("o_orderkey").alias("current_revision_id"))


@query(f"""
WITH {CLAIMS}, nb AS (SELECT s.s_suppkey AS query_id, subject AS k, predicate, confidence FROM supplier s JOIN c ON object = 's' || s.s_suppkey WHERE status = 'explicit'),
b AS (SELECT query_id, k, predicate, max(confidence) AS cf FROM nb GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cf DESC, k, predicate) AS n FROM b)
SELECT query_id, k AS entity_key, round(max(least(0.10, CASE predicate WHEN 'fixes' THEN 0.10 WHEN 'depends_on' THEN 0.06 ELSE 0.03 END * cf)), 6) AS weight FROM r WHERE n <= 20 GROUP BY 1, 2
""")
def gr_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-3, JN-6, JN-7, AG-1, AG-2, TK-5, SET-2, FLT-11: each supplier is a query's seed."""
    t = Tables(spark, sf_dir)
    seeds = t.supplier.select(F.col("s_suppkey").alias("query_id"), name("s", "s_suppkey").alias("entity_key"))
    return G.expand(seeds, claims_of(t).filter("status = 'explicit'")).withColumn("weight", F.round("weight", 6))


@query("""
WITH q AS (SELECT c_custkey AS query_id, CASE WHEN c_nationkey % 2 = 0 THEN 'nation_' || c_nationkey ELSE 'n' || c_nationkey END AS k FROM customer)
SELECT DISTINCT query_id, lower(n_name) AS entity_key FROM q JOIN nation ON lower(n_name) = k OR 'n' || n_nationkey = k
""")
def gr_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-11, SET-1: nation names are keys, n<key> aliases."""
    t = Tables(spark, sf_dir)
    q = t.customer.select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_nationkey") % 2 == 0, name("nation_", "c_nationkey")).otherwise(name("n", "c_nationkey")).alias("name_key"))
    e = t.nation.select(F.lower("n_name").alias("entity_key"))
    a = t.nation.select(name("n", "n_nationkey").alias("alias_key"), F.lower("n_name").alias("entity_key"))
    return G.resolve(q, e, a)


REACH = f"""WITH RECURSIVE {EDGES}, un AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
w AS (SELECT 'r0' AS node, 0 AS hops UNION SELECT b, hops + 1 FROM w JOIN un ON a = node WHERE hops < {{0}}), n AS (SELECT node, min(hops)::INT AS hops FROM w GROUP BY 1)"""


@query(f"{REACH.format(3)} SELECT node, hops FROM n")
def gr_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-4: three hops around a region."""
    return G.reached(spark.range(1).select(F.lit("r0").alias("node")), edges_of(Tables(spark, sf_dir)), 3)


@query(f"{REACH.format(2)} SELECT src, dst, relation FROM ed WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def gr_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-4, induced subgraph."""
    e = edges_of(Tables(spark, sf_dir))
    return G.induced(G.reached(spark.range(1).select(F.lit("r0").alias("node")), e, 2), e).select("src", "dst", "relation")


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT 's3' AS node, 0 AS hops UNION SELECT dst, hops + 1 FROM w JOIN ed ON src = node WHERE hops < 2) SELECT node, min(hops)::INT AS hops FROM w GROUP BY 1""")
def gr_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-5: directed, start without case."""
    return G.ego(F.lit("S3"), edges_of(Tables(spark, sf_dir)), 2)


@query(f"""WITH {EDGES}, q AS (SELECT n_nationkey AS query_id, 'N' || n_nationkey AS nm FROM nation), en AS (SELECT src AS x, dst AS y FROM ed UNION ALL SELECT dst, src FROM ed),
h AS (SELECT query_id, x, y FROM q JOIN en ON lower(nm) = lower(x))
SELECT query_id, nm AS name FROM q UNION SELECT query_id, x FROM h UNION SELECT query_id, y FROM h""")
def gr_expand_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-9, SET-7."""
    t = Tables(spark, sf_dir)
    return G.expand_old(t.nation.select(F.col("n_nationkey").alias("query_id"), name("N", "n_nationkey").alias("name")), edges_of(t))


@query(f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM ed UNION ALL SELECT dst FROM ed) GROUP BY 1")
def gr_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-20, GR-10."""
    return G.degrees(edges_of(Tables(spark, sf_dir)))


@query("SELECT l_partkey AS src, l_suppkey AS dst, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS relation FROM lineitem GROUP BY 1, 2")
def gr_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-5, GR-10: later edges win."""
    t = Tables(spark, sf_dir)
    e = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return G.compose(e, ["src", "dst"], "seq")


@query(f"""WITH {CLAIMS} SELECT claim_id, p_name AS source, predicate AS relation, coalesce(s_name, 'Literal:' || claim_id) AS target, round(confidence, 4) AS confidence, s_name IS NULL AS literal
FROM c JOIN orders ON o_orderkey = evidence AND o_orderstatus = 'F' JOIN part ON 'p' || p_partkey = subject LEFT JOIN supplier ON 's' || s_suppkey = object AND s_acctbal > 0 WHERE status = 'explicit'""")
def gr_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-6, JN-9, PRJ-15: suppliers in debt are no entities, so they are literals."""
    t = Tables(spark, sf_dir)
    e = t.part.select(name("p", "p_partkey").alias("entity_key"), F.col("p_name").alias("canonical_name")).unionByName(t.supplier.filter("s_acctbal > 0").select(name("s", "s_suppkey").alias("entity_key"), F.col("s_name").alias("canonical_name")))
    return G.export(claims_of(t), e, documents_of(t)).withColumn("confidence", F.round("confidence", 4))


@query(f"""WITH {CLAIMS}, d AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
k AS (SELECT 's' || (o_custkey % 50) AS k FROM orders WHERE o_orderkey IN (SELECT * FROM d) UNION SELECT subject FROM c WHERE status = 'explicit' AND evidence IN (SELECT * FROM d) UNION SELECT object FROM c WHERE status = 'explicit' AND evidence IN (SELECT * FROM d))
SELECT DISTINCT canonical_name FROM (SELECT 'p' || p_partkey AS k, p_name AS canonical_name FROM part UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier) WHERE k IN (SELECT k FROM k)""")
def gr_evidenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-7, JN-12, AG-5."""
    t = Tables(spark, sf_dir)
    e = t.part.select(name("p", "p_partkey").alias("entity_key"), F.col("p_name").alias("canonical_name")).unionByName(t.supplier.select(name("s", "s_suppkey").alias("entity_key"), F.col("s_name").alias("canonical_name")))
    m = t.orders.select(F.col("o_orderkey").alias("memory_id"), F.col("o_orderkey").alias("revision_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("entity_key"))
    return G.evidenced(e, m, claims_of(t), documents_of(t))


@query(f"WITH {EDGES} SELECT CASE WHEN src = 'n3' THEN upper(relation) ELSE 'INVERSE_' || upper(relation) END AS relation, CASE WHEN src = 'n3' THEN dst ELSE src END AS other FROM ed WHERE src = 'n3' OR dst = 'n3'")
def gr_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-8, PRJ-16."""
    return G.relations(edges_of(Tables(spark, sf_dir)), F.lit("N3"))




@query(r"""
WITH d AS (SELECT 'DOC:d' || doc_id AS doc, string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM
  (SELECT doc_id, regexp_replace(text, '\b(the|de|der|la) ([A-Za-z]+)', 'uses [[\2]] and fixes [[\2x]]', 'g') AS text FROM documents)),
s AS (SELECT doc, generate_subscripts(ss, 1) AS pl, unnest(ss) AS s FROM d),
n AS (SELECT *, list_distinct(regexp_extract_all(s, '\[\[(.*?)\]\]', 1)) AS nd, regexp_extract_all(s, '\[\[(.*?)\]\]', 1)[1] AS first FROM s WHERE contains(s, '[[')),
e AS (SELECT doc, pl, 0 AS rule, 0 AS i, doc AS src, unnest(nd) AS dst, 'references' AS relation FROM n
  UNION ALL SELECT doc, pl, 1, i, CASE WHEN len(nd) > 1 AND first <> dst THEN first ELSE doc END, dst, 'uses' FROM (SELECT *, unnest(regexp_extract_all(s, 'uses\s+\[\[(.*?)\]\]', 1)) AS dst, generate_subscripts(regexp_extract_all(s, 'uses\s+\[\[(.*?)\]\]', 1), 1) AS i FROM n)
  UNION ALL SELECT doc, pl, 3, i, CASE WHEN len(nd) > 1 AND first <> dst THEN first ELSE doc END, dst, 'fixes' FROM (SELECT *, unnest(regexp_extract_all(s, 'fixes\s+\[\[(.*?)\]\]', 1)) AS dst, generate_subscripts(regexp_extract_all(s, 'fixes\s+\[\[(.*?)\]\]', 1), 1) AS i FROM n))
SELECT src, dst, arg_max(relation, (doc, pl, rule, i)) AS relation FROM e GROUP BY 1, 2
""")
def gr_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-2, SC-4, SC-25: links are made from words after articles."""
    d = Tables(spark, sf_dir).documents
    text = F.regexp_replace("text", r"\b(the|de|der|la) ([A-Za-z]+)", "uses [[$2]] and fixes [[$2x]]")
    return G.prose(d.select(name("d", "doc_id").alias("source_file"), text.alias("text")))


@query("""
WITH n AS (SELECT p_partkey AS memory_id, p_name || ' ' || p_partkey AS title, p_type, replace(p_brand, '#', '-') AS p_brand, p_size FROM part),
e AS (SELECT memory_id, title AS name, 'concept' AS kind FROM n UNION ALL SELECT memory_id, p_brand, 'concept' FROM n UNION ALL SELECT memory_id, p_type, 'concept' FROM n),
c AS (SELECT memory_id, lower(title) AS subject, 'related_to' AS predicate, lower(p_brand) AS object, 1.0::DOUBLE AS confidence FROM n
  UNION ALL SELECT memory_id, lower(title), 'uses', lower(p_type), CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE FROM n)
SELECT 'entity' AS what, lower(name) AS a, arg_min(name, (memory_id, name)) AS b, count(*) > 0 AS seen, 0.0::DOUBLE AS confidence FROM e GROUP BY lower(name)
UNION ALL SELECT 'claim', subject, predicate || '>' || object, true, confidence FROM c
UNION ALL SELECT 'mention', memory_id::VARCHAR, lower(p_type), true, 0.0 FROM n
""")
def gr_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR-1, SNK-4, SNK-6: parts as parsed notes: the brand is related, the type is linked and used."""
    p = Tables(spark, sf_dir).part.withColumn("p_brand", F.replace("p_brand", F.lit("#"), F.lit("-")))
    rel = F.array(F.struct(F.lit("uses").alias("predicate"), F.col("p_type").alias("target"), F.when(F.col("p_size") % 2 == 0, "verified").otherwise("candidate").alias("status")))
    notes = p.select(
        F.col("p_partkey").alias("memory_id"), F.col("p_partkey").alias("seq"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.lit("concept").alias("memory_type"),
        F.array(F.concat(F.lit("[["), "p_brand", F.lit("]]"))).alias("entities"), F.array(F.concat(F.lit("[["), "p_brand", F.lit("|x]]"))).alias("related_to"), rel.alias("relationships"),
        F.concat(F.lit("made as [["), "p_type", F.lit("]]")).alias("body"), F.lit(None).cast("string").alias("occurred"), F.lit("2024-01-01").alias("created"),
    )
    made = G.project(notes)
    none = F.lit(0.0)
    e = made["entities"].select(F.lit("entity").alias("what"), F.col("entity_key").alias("a"), F.col("canonical_name").alias("b"), F.lit(True).alias("seen"), none.alias("confidence"))
    c = made["claims"].select(F.lit("claim").alias("what"), F.col("subject").alias("a"), F.concat_ws(">", "predicate", "object").alias("b"), F.lit(True).alias("seen"), "confidence")
    m = made["mentions"].select(F.lit("mention").alias("what"), F.col("memory_id").cast("string").alias("a"), F.col("entity_key").alias("b"), F.lit(True).alias("seen"), none.alias("confidence"))
    return e.unionAll(c).unionAll(m)
