"""Text functions, identifiers and chunking over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as T
from ..functions import udfs, vectors
from ..operators import chunking
from .base import Tables, query

SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(r"SELECT doc_id, len(l) AS n, sha256(array_to_string(l, ' ')) AS digest FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS l FROM documents)")
def tx_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-5, SC-31."""
    d = Tables(spark, sf_dir).documents.select("doc_id", F.sort_array(T.lexemes(F.col("text"))).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n"), F.sha2(F.array_join("l", " "), 256).alias("digest"))


@query(rf"SELECT doc_id, len(s) AS n, s[1] AS first, CAST(floor(len(regexp_extract_all(text, '[^\s]+')) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM (SELECT *, {SENT.format('text')} AS s FROM documents)")
def tx_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-14, SC-19."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0)).alias("first"), T.token_estimate(F.col("text")).alias("tokens"))


@query(rf"""SELECT doc_id, sha256(CASE WHEN CAST(floor(len(regexp_extract_all(text, '[^\s]+')) * 1.3::DOUBLE) AS BIGINT) <= 100 OR len(s) <= 4 THEN text ELSE s[1] || ' ' || s[2] || chr(10) || '... [Content Compressed] ...' || chr(10) || s[-2] || ' ' || s[-1] END) AS extract,
  sha256(CASE WHEN len(s) <= 2 THEN text ELSE s[1] || ' ... [Distilled] ... ' || s[-1] END) AS summary FROM (SELECT *, {SENT.format('text')} AS s FROM documents)""")
def tx_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-15, SC-16."""
    return Tables(spark, sf_dir).documents.select("doc_id", F.sha2(T.extractive(F.col("text"), F.lit(100)), 256).alias("extract"), F.sha2(T.heuristic_summary(F.col("text")), 256).alias("summary"))


@query(rf"""SELECT doc_id, CASE WHEN length(f) > 60 THEN (CASE WHEN contains(left(f, 60), ' ') THEN rtrim(regexp_replace(left(f, 60), ' [^ ]*$', '')) ELSE left(f, 60) END) || '...' ELSE f END AS short,
  CASE WHEN length(f) <= 80 THEN f ELSE rtrim(left(f, 80)) || chr(10) || chr(10) || '...' END AS excerpt FROM (SELECT doc_id, {FLAT} AS f FROM documents)""")
def tx_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-17, SC-27."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return Tables(spark, sf_dir).documents.select("doc_id", T.truncate_words(F.col("text"), 60).alias("short"), T.excerpt(flat, 80).alias("excerpt"))


@query("SELECT event_id, concat_ws('|', CASE WHEN event_type = 'error' THEN 'Identified error pattern requiring structural patch.' END, CASE WHEN event_type = 'signup' THEN 'Sequence of operations detected.' END) AS lessons FROM events")
def tx_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-18."""
    text = F.when(F.col("event_type") == "signup", "Step one").otherwise(F.initcap("event_type"))
    return Tables(spark, sf_dir).events.select("event_id", F.array_join(T.lessons(text), "|").alias("lessons"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, lower(p_name || ' ' || p_type) AS entity_key, replace(lower(p_type), ' ', '_') AS predicate, '#' || p_brand AS tags FROM part")
def tx_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-1 (ASCII), SC-3, PRJ-4, PRJ-17."""
    p = Tables(spark, sf_dir).part
    return p.select(
        "p_partkey", T.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"), T.entity_key(F.concat(F.lit("  "), "p_name", F.lit(" \t"), "p_type")).alias("entity_key"), T.predicate(F.col("p_type")).alias("predicate"),
        F.array_join(T.hash_tags(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(""), "p_brand")), ",").alias("tags"),
    )


@query("SELECT p_partkey, p_name AS link, p_name || ',' || p_type AS links, 'a-b,c' AS tags FROM part WHERE p_name <> p_type")
def tx_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-2, PRJ-11, SC-22."""
    p = Tables(spark, sf_dir).part.filter("p_name <> p_type")
    text = F.concat(F.lit("see [["), "p_name", F.lit("|alias]] and [["), "p_type", F.lit("#part]] or [["), "p_name", F.lit("]] #a-b x#d\n#c"))
    return p.select("p_partkey", T.clean_link(F.concat(F.lit(" [["), "p_name", F.lit("#x|y]] "))).alias("link"), F.array_join(T.links(text), ",").alias("links"), F.array_join(T.tags(text), ",").alias("tags"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'procedural' WHEN 1 THEN 'episodic' WHEN 2 THEN 'goal' ELSE 'semantic' END AS memory_type, CASE p_size % 5 WHEN 0 THEN 'Tasks' WHEN 1 THEN 'Daily' ELSE 'Concepts' END AS folder, CASE WHEN p_size % 2 = 0 THEN 'archived' WHEN p_size % 3 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'a/b.md' END AS path FROM part")
def tx_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-3, PRJ-6, PRJ-7, PRJ-18, AX-3."""
    n = F.col("p_size")
    alias = F.when(n % 5 == 0, " Tasks ").when(n % 5 == 1, "DAILY").when(n % 5 == 2, "objective").when(n % 5 == 3, "unknown")
    route = F.when(n % 5 == 0, "Procedural").when(n % 5 == 1, "daily").otherwise("other")
    path = F.when(n % 2 == 0, "Archive/x.md").otherwise("x.md")
    raw = F.when(n % 7 == 0, "a/../../b.md").otherwise("./a//b.md")
    return Tables(spark, sf_dir).part.select("p_partkey", T.memory_type(alias).alias("memory_type"), T.folder(route).alias("folder"), T.document_status(path, F.when(n % 3 == 0, "Superseded")).alias("status"), T.vault_path(raw).alias("path"))


@query("SELECT n_nationkey, '# ' || r_name || chr(10) || '## ' || n_name AS context FROM nation JOIN region ON r_regionkey = n_regionkey")
def tx_heading_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10."""
    t = Tables(spark, sf_dir)
    return t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", T.heading_context(F.array("r_name", "n_name")).alias("context"))




@query("""SELECT doc_id, sha256(encode('projection-v2') || '\\x00'::BLOB || encode(text)) AS content_hash, md5('c' || doc_id) AS point_raw, left(sha256('d' || doc_id || '::a|b::' || 3), 12) AS label FROM documents""")
def tx_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-13, evidence and chunk identifiers."""
    d = Tables(spark, sf_dir).documents
    i = F.col("doc_id").cast("string")
    return d.select("doc_id", I.content_hash(F.col("text")).alias("content_hash"), F.replace(I.point_id(F.concat(F.lit("c"), i)), F.lit("-"), F.lit("")).alias("point_raw"), I.chunk_label(F.concat(F.lit("d"), i), F.array(F.lit("a"), F.lit("b")), F.lit(3)).alias("label"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('Concepts/' || doc_id || '.md')) AS h FROM documents)
SELECT doc_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS memory_id FROM h""")
def tx_memory_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version-5 identifiers (SNK-20); tested against Python's too."""
    d = Tables(spark, sf_dir).documents.select("doc_id", F.concat(F.lit("Concepts/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return d.select("doc_id", I.memory_id(F.lit(None).cast("string"), F.col("path")).alias("memory_id"))


TERMS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9_]{{3,}}'), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from')))"


@query(f"""WITH t AS (SELECT conv_id, {TERMS.format('text')} AS ts FROM conversations WHERE turn = 0)
SELECT c.conv_id, c.turn, coalesce(CAST(list_sum(list_transform(ts, lambda x: (length(lower(c.text)) - length(replace(lower(c.text), x, ''))) // length(x))) AS BIGINT), 0) AS score FROM conversations c JOIN t USING (conv_id)""")
def tx_term_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-26: each turn by the terms of its conversation's first."""
    c = Tables(spark, sf_dir).conversations
    t = c.filter("turn = 0").select("conv_id", T.task_terms(F.col("text")).alias("ts"))
    return c.join(t, "conv_id").select("conv_id", "turn", T.term_score(F.col("text"), F.col("ts")).alias("score"))


_ANY = lambda words, t="t": "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"
_CODING = _ANY(["code", "script", "debug", "error", "refactor", "build"])
_RESEARCH = _ANY(["explain", "research", "what is", "why", "how does"])


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS t, text FROM documents)
SELECT doc_id, CASE WHEN {_CODING} THEN 'coding' WHEN {_RESEARCH} THEN 'research' ELSE 'general' END AS task,
  CASE WHEN {_ANY(["how to", "step", "code", "fix", "debug"])} THEN 'procedural' WHEN contains(t, 'summarize') THEN 'summary' ELSE 'semantic' END AS intent,
  CASE WHEN {_ANY(["bug", "error", "issue"])} THEN 'issue' WHEN {_ANY(["fix", "patch"])} THEN 'fix' WHEN {_ANY(["architecture", "system"])} THEN 'architecture' WHEN {_ANY(["how to", "step"])} THEN 'procedure' ELSE 'other' END AS kind,
  concat_ws('|', CASE WHEN {_ANY(["error", "fail"])} THEN 'Identified error pattern requiring structural patch.' END, CASE WHEN contains(t, 'docker') THEN 'Docker environments require port mapping verification.' END, CASE WHEN contains(t, 'step') THEN 'Sequence of operations detected.' END) AS lessons FROM d""")
def tx_text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-18, SC-21, SC-24, SC-28 over whole texts."""
    d, t = Tables(spark, sf_dir).documents, F.col("text")
    kind = T.entity_type(t)
    return d.select("doc_id", T.task_type(t).alias("task"), T.intent(t).alias("intent"), F.when(kind.isin("issue", "fix", "architecture", "procedure"), kind).otherwise("other").alias("kind"), F.array_join(T.lessons(t), "|").alias("lessons"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'coding' WHEN 'view' THEN 'research' ELSE 'general' END AS task, CASE event_type WHEN 'error' THEN 'procedural' WHEN 'view' THEN 'summary' ELSE 'semantic' END AS intent, CASE event_type WHEN 'error' THEN 'coding' ELSE 'research' END AS profile,
  CASE event_type WHEN 'error' THEN 'issue' WHEN 'view' THEN 'architecture' WHEN 'click' THEN 'person' ELSE 'concept' END AS kind FROM events""")
def tx_classifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-21, SC-23, SC-24, SC-28."""
    k = F.col("event_type")
    text = F.when(k == "error", "Debug this").when(k == "view", "Explain, summarize").otherwise(k)
    name = F.when(k == "error", "Parse Error").when(k == "view", "the System").when(k == "click", "Ada Lovelace").otherwise("plain Name")
    return Tables(spark, sf_dir).events.select("event_id", T.task_type(text).alias("task"), T.intent(text).alias("intent"), T.compression_profile(T.intent(text)).alias("profile"), T.entity_type(name).alias("kind"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'procedural:Fix applied: rebooting' WHEN 'view' THEN 'semantic:Decision made: go' WHEN 'click' THEN 'episodic:Task completed: It completed.' ELSE '' END AS insights FROM events""")
def tx_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-28."""
    k = F.col("event_type")
    text = F.when(k == "error", "Resolution: rebooting\n\nmore").when(k == "view", "x DECISION: go").when(k == "click", "It completed. Then more").otherwise("nothing")
    return Tables(spark, sf_dir).events.select("event_id", F.array_join(F.transform(T.insights(text), lambda x: F.concat_ws(":", x["category"], x["text"])), "|").alias("insights"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events")
def tx_iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-30: ISO text with Z; what isn't a time is null."""
    e = Tables(spark, sf_dir).events
    text = F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", F.unix_micros(T.iso_timestamp(text)).alias("us"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || '=' || CAST(json_extract(props, '$.k') AS VARCHAR) AS item FROM events")
def tx_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-29, SC-32."""
    e = Tables(spark, sf_dir).events.withColumn("v", F.parse_json("props"))
    k = F.variant_get("v", "$.k", "long")
    return e.select("event_id", k.alias("k"), F.concat_ws("=", "event_type", F.element_at(F.map_concat(F.create_map(F.lit("k"), F.lit("-")), F.create_map(F.lit("j"), k.cast("string"))), "j")).alias("item"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def tx_vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-11, SC-12: the mean of a vector with itself is itself, of unit length."""
    e = Tables(spark, sf_dir).embeddings
    mean = vectors.weighted_mean(F.array("embedding", "embedding"), F.array(F.lit(1.0), F.lit(3.0)), 64)
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")) * vectors.dot(mean, vectors.normalised(F.col("embedding"))), 4).alias("norm"))


@query("SELECT doc_id, ordinal, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0")
def tx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-11, PRJ-8: lines with their ordinals."""
    d = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return d.filter(F.length("line") > 0).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "line")


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, ls, 1 AS i, 0 AS size, 0 AS parts FROM l
  UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN size > 0 AND size + length(ls[i]) > 1500 THEN length(ls[i]) ELSE size + length(ls[i]) END, CASE WHEN parts = 0 OR (size > 0 AND size + length(ls[i]) > 1500) THEN parts + 1 ELSE parts END FROM f WHERE i <= len(ls))
SELECT doc_id, max(parts)::INT AS parts FROM f GROUP BY 1""")
def tx_packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-9: greedy packing of lines."""
    return Tables(spark, sf_dir).documents.select("doc_id", F.size(chunking.pack_lines(F.split("text", "\n"), 1500)).alias("parts"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<h1>(.*?)</h1>', 1)) AS heading, len(regexp_extract_all(html, '<a href="/[^"]*"')) AS links FROM pages""")
def tx_page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-8, PRJ-11 on pages: headings and anchors stand for headings and links."""
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h1>(.*?)</h1>"), F.lit(1))).alias("heading"), F.regexp_count("html", F.lit('<a href="/[^"]*"')).cast("long").alias("links"))


@query("""WITH c AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
b AS (SELECT *, (turn - first) % 2 AS deep, role || turn AS name, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM c)
SELECT conv_id, turn, 'T' || conv_id || CASE WHEN deep = 1 THEN '/' || lag(name) OVER (PARTITION BY conv_id ORDER BY turn) ELSE '' END || '/' || name AS heading_path,
  sha256(CASE WHEN turn % 3 = 0 THEN '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) ELSE '' END || flat) AS text FROM b""")
def tx_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-8, WN-7, WN-8: a conversation as a note: turns under headings of two levels, some with a fence that holds a heading."""
    c = Tables(spark, sf_dir).conversations.withColumn("first", F.min("turn").over(Window.partitionBy("conv_id")))
    marks = F.when((F.col("turn") - F.col("first")) % 2 == 1, "### ").otherwise("## ")
    fence = F.when(F.col("turn") % 3 == 0, "```\n# not a heading\n```\n").otherwise("")
    part = F.concat(marks, "role", F.col("turn").cast("string"), F.lit("\n"), fence, F.trim(F.regexp_replace("text", r"\s+", " ")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n")
    notes = c.groupBy("conv_id").agg(F.concat(F.lit("# T"), F.first("conv_id").cast("string"), F.lit("\n"), body).alias("body"), F.sort_array(F.collect_list("turn")).alias("turns"))
    made = chunking.chunks(notes.select(F.col("conv_id").cast("string").alias("memory_id"), F.lit("x.md").alias("path"), "body", F.lit("h").alias("content_hash")), 10**9)
    at = notes.select("conv_id", F.posexplode("turns").alias("ordinal", "turn"))
    both = made.join(at, (made["memory_id"] == at["conv_id"].cast("string")) & (made["ordinal"] == at["ordinal"]))
    return both.select("conv_id", "turn", F.array_join("heading_path", "/").alias("heading_path"), F.sha2(F.substring_index("content", "\n\n", -1), 256).alias("text"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'made_of>' || p_type || '>explicit' WHEN 1 THEN 'sold_by>' || p_name || '>candidate' ELSE '' END AS relationships FROM part""")
def tx_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-5: alias keys, links as targets, a default status; without a target: none."""
    n, text = F.col("p_size") % 3, lambda c: F.concat(F.lit("[["), c, F.lit("|alias]]"))
    one = F.create_map(F.lit("relation"), F.lit("Made-of"), F.lit("object"), text("p_type"))
    two = F.create_map(F.lit("type"), F.lit("sold by"), F.lit("entity"), F.col("p_name"), F.lit("status"), F.lit("candidate"))
    none = F.create_map(F.lit("predicate"), F.lit("x"), F.lit("target"), F.lit(" "))
    made = T.relationships(F.array(F.when(n == 0, one).when(n == 1, two).otherwise(none)))
    return Tables(spark, sf_dir).part.select("p_partkey", F.array_join(F.transform(made, lambda r: F.concat_ws(">", r["predicate"], r["target"], r["status"])), "|").alias("relationships"))


@query("""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[^\\s]+') AS w FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ')) AS merged FROM l""")
def tx_merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-6: lists merged in order, each item once: the two halves of a text's words."""
    w = T.split_words(F.col("text"))
    half = F.floor(F.size(w) / 2).cast("int")
    both = F.flatten(F.array(F.slice(w, F.lit(1), half), F.slice(w, half + 1, F.size(w))))
    return Tables(spark, sf_dir).documents.select("doc_id", F.sha2(F.array_join(F.array_distinct(both), " "), 256).alias("merged"))


@query("""WITH s AS (SELECT item_id, ('0x' || left(md5(t), 8))::BIGINT AS h FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark))
SELECT item_id, (h % 256)::INT AS place, sum(CASE WHEN (h // 256) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS value FROM s GROUP BY 1, 2 HAVING value <> 0""")
def tx_word_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UX-1, RET-3: the offline provider that knows words."""
    v = Tables(spark, sf_dir).benchmark.select("item_id", udfs.embed_udf(udfs.hashed_embeddings)("text").alias("v"))
    return v.select("item_id", F.posexplode("v").alias("place", "value")).filter("value <> 0").select("item_id", "place", F.col("value").cast("double").alias("value"))


@query()
def tx_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1, PRJ-2, PRJ-8 to PRJ-12: notes with front matter and headings, parsed and cut (tested by hand-made notes)."""
    d = Tables(spark, sf_dir).documents
    raw = F.concat(F.lit("---\ntype: concept\ntags: [a, b]\n---\n# "), "source", F.lit("\n"), F.regexp_replace("text", r"\n", "\n\n"))
    notes = chunking.parsed(d.select(F.concat(F.lit("Concepts/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), raw.alias("raw")))
    return chunking.chunks(notes).select("chunk_id", "memory_id", "path", "ordinal", F.array_join("heading_path", "/").alias("heading_path"), F.length("content").alias("n_chars"))


@query()
def tx_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UX-1, UX-2, RET-3: deterministic embeddings of passages, long ones by halves."""
    b = Tables(spark, sf_dir).benchmark
    return b.select("item_id", udfs.embed_udf(dim=64, most=200)("text").alias("vec")).select("item_id", F.size("vec").alias("n"), F.round(vectors.norm(F.col("vec")), 3).alias("norm"))


@query("SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS entity_key FROM part")
def tx_entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-1: NFKC keys; the SQL is their form for ASCII, which the names are."""
    return Tables(spark, sf_dir).part.select("p_partkey", udfs.entity_key_udf()("p_name").alias("entity_key"))
