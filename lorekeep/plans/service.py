"""The service around retrieval: change feed, degradation, default filters, model plug-ins, and word lists on texts that hold them.

The tables' prose is invented.  Where word lists are judged, a word or two of
them, picked by a row's key, is put in front of each row's whole text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..api import Memory, SearchOptions
from ..functions import text as T
from ..functions import vocab
from ..operators import chunking, episodes, identity, models, readiness, vault_jobs
from ..operators.kept_index import KeptIndex
from ..sources import vault
from ..sources.commits import CommitLog
from .base import Tables, query, stamp
from .retrieval import BASE, LEXICAL, RECENCY, TOKENS, expected, queries_of


@query("""
WITH b AS (SELECT 'Notes/' || doc_id || '.md' AS path, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0),
a AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'Moved/' || doc_id || '.md' WHEN doc_id % 11 = 0 THEN '.trash/' || doc_id || '.md' ELSE 'Notes/' || doc_id || '.md' END AS path, md5(CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE text END) AS h FROM documents),
v AS (SELECT * FROM a WHERE NOT starts_with(path, '.')),
o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM b WHERE path NOT IN (SELECT path FROM v)),
w AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY path) AS n FROM v WHERE path NOT IN (SELECT path FROM b)),
m AS (SELECT w.path AS dst, o.path AS src FROM w JOIN o USING (h, n))
SELECT path, 'modified' AS event_type, 0 AS seq FROM b JOIN v USING (path) WHERE b.h <> v.h
UNION ALL SELECT path, 'created', 0 FROM w WHERE path NOT IN (SELECT dst FROM m)
UNION ALL SELECT path, 'deleted', 0 FROM o WHERE path NOT IN (SELECT src FROM m)
UNION ALL SELECT dst, 'moved_to', 0 FROM m UNION ALL SELECT src, 'moved_from', 1 FROM m
""")
def src_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-4, FLT-10: events between two listings of notes: some are new, changed, moved or moved to the bin."""
    d, i = Tables(spark, sf_dir).documents, F.col("doc_id")
    path = lambda folder: F.concat(F.lit(folder), i.cast("string"), F.lit(".md"))
    before = d.filter(i % 7 != 0).select(path("Notes/").alias("path"), F.md5("text").alias("content_hash"))
    now = F.when(i % 5 == 0, path("Moved/")).when(i % 11 == 0, path(".trash/")).otherwise(path("Notes/"))
    after = d.select(now.alias("path"), F.md5(F.when(i % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))).alias("content_hash"))
    return vault.changes(before, after)


READERS = {"chunker": "(?ms)^---\\n(.*?)\\n---(.*)", "distiller": "(?s)\\A---\\n(.*?)\\n---\\n(.*)", "quality": "(?s)\\A---\\n(.*?)\\n---\\n(.*)"}
_HEADS = "CASE doc_id % 5 WHEN 0 THEN '---' || chr(10) || 'type: a' || chr(10) || '---' || chr(10) WHEN 1 THEN 'intro' || chr(10) || '---' || chr(10) || 'x: 1' || chr(10) || '---' || chr(10) WHEN 2 THEN '---' || chr(10) || 'x' || chr(10) || '---' WHEN 3 THEN '---' || chr(10) || chr(10) || '---' || chr(10) || '  ' ELSE '' END"


@query("WITH r AS (SELECT doc_id, " + _HEADS + " || text AS raw FROM documents) " + " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS reader, CASE WHEN regexp_matches(raw, '{p}') THEN regexp_extract(raw, '{p}', 1) END AS head, sha256(CASE WHEN NOT regexp_matches(raw, '{p}') THEN raw ELSE "
    + (f"regexp_replace(regexp_extract(raw, '{p}', 2), '^\\s+|\\s+$', '', 'g')" if k != "quality" else f"regexp_extract(raw, '{p}', 2)") + " END) AS body FROM r" for k, p in READERS.items()))
def tx_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-12: what three readers take for front matter in front of whole documents."""
    n = F.col("doc_id") % 5
    head = F.when(n == 0, "---\ntype: a\n---\n").when(n == 1, "intro\n---\nx: 1\n---\n").when(n == 2, "---\nx\n---").when(n == 3, "---\n\n---\n  ").otherwise("")
    d = Tables(spark, sf_dir).documents.select("doc_id", F.concat(head, "text").alias("raw"))
    each = F.array(*[F.struct(F.lit(k).alias("reader"), T.front_matter(F.col("raw"), k).alias("m")) for k in T.FRONT_MATTER])
    return d.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.reader", F.col("x.m.head").alias("head"), F.sha2(F.col("x.m.body"), 256).alias("body"))


def memory_of(t: Tables, **more) -> Memory:
    """Documents as one-chunk memories: poor ones are archived, the event of the same number dates them, the source is the project."""
    poor = t.labels.filter("quality = 0").select(F.col("doc_id").alias("memory_id")).withColumn("poor", F.lit(True))
    dated = t.events.select(F.col("event_id").alias("chunk_id"), F.col("ts").cast("timestamp").alias("created"))
    none = {"occurred": "timestamp", "updated": "timestamp", "importance": "double"}
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("memory_id"), F.col("doc_id").alias("revision_id"), "text", F.lit("semantic").alias("memory_type"), F.col("source").alias("project"), F.lit("bot").alias("source_agent"), F.array("lang").alias("tags"), F.array().cast("array<string>").alias("entity_keys"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_file"))
    chunks = d.join(dated, "chunk_id", "left").withColumns({c: F.lit(None).cast(k) for c, k in none.items()})
    documents = d.select("memory_id", F.col("revision_id").alias("current_revision_id")).join(poor, "memory_id", "left").withColumn("doc_status", F.when(F.col("poor"), "archived").otherwise("active")).drop("poor")
    return Memory(chunks, documents, d.select("memory_id", "revision_id", F.lit("active").alias("state")), **more)


def _ranked(where: str = "", items: str = "benchmark", first: str = "") -> str:
    """SQL (up to a table r) of a search whose only leg is the lexical one, over the documents of a source if given, for other query texts if given."""
    lexical = LEXICAL.replace("FROM documents)", f"FROM documents{where})").replace("FROM benchmark)", f"FROM {items})")
    return f"""WITH {first}{lexical}, fu AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + pos) AS rrf, NULL::DOUBLE AS semantic, rank AS lexical, 1 AS n_lists FROM lx WHERE pos <= 20),
v AS (SELECT fu.*, d.text, e.ts FROM fu JOIN documents d ON d.doc_id = chunk_id LEFT JOIN events e ON e.event_id = chunk_id WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
b AS (SELECT *, {BASE} AS base, {RECENCY.format('ts')} AS temporal FROM v),
c AS (SELECT b.*, least(1.0, base + temporal) AS score, greatest(0, least(1, 0.7::DOUBLE * len(list_intersect(list_distinct({TOKENS.format('q.text')}), {TOKENS.format('b.text')})) / greatest(len(list_distinct({TOKENS.format('q.text')})), 1) + 0.3::DOUBLE * least(1, 200.0::DOUBLE / greatest(length(b.text), 1)))) AS rr
  FROM b JOIN {items} q ON q.item_id = query_id),
s AS (SELECT query_id, chunk_id, rrf, least(1.0, 0.8::DOUBLE * score + 0.2::DOUBLE * rr) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, chunk_id) AS pos FROM s)"""


def _alone(where: str = "") -> str:
    return _ranked(where) + " SELECT query_id, pos, chunk_id, round(score, 5) AS score FROM r WHERE pos <= 5"


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("pos").cast("long").alias("pos"), "chunk_id", F.round("score", 5).alias("score"))


@query(_alone())
def ret_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-15: the search without vectors, claims and profiles: the lexical leg answers."""
    t = Tables(spark, sf_dir)
    return _shown(memory_of(t).search(queries_of(t), stamp("2024-02-01"), SearchOptions(limit=5, compress=False)))


@query(_alone())
def ret_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-1, RET-15: the same search, from a kept index of the documents."""
    t = Tables(spark, sf_dir)
    index = KeptIndex(CommitLog(spark, f"{scratch.root(spark)}/lorekeep/log-{uuid.uuid4().hex}"), buckets=16)
    index.update(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"))
    return _shown(memory_of(t, index=index).search(queries_of(t), stamp("2024-02-01"), SearchOptions(limit=5, compress=False)))


@query(_alone(" WHERE source = (SELECT min(source) FROM documents)"))
def ax_default_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AX-2, FLT-2: a client's default project is a filter in front of the search."""
    t = Tables(spark, sf_dir)
    project = t.documents.agg(F.min("source")).first()[0]
    return _shown(memory_of(t).search(queries_of(t), stamp("2024-02-01"), SearchOptions(limit=5, compress=False, default_project=project)))


@query(r"""WITH n AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '---'))[1] AS first FROM documents)
SELECT doc_id AS id, coalesce(CASE WHEN starts_with(first, '# ') THEN trim(first[3:]) ELSE left(first, 80) END, 'Memory') AS title, sha256(text) AS body FROM n""")
def ux_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UX-4: notes to write for inputs, as they are without a model, or where the model's answer is no such note."""
    d = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), "text")
    return models.written(d, models.mock).select("id", "title", F.sha2("body", 256).alias("body"))


@query("""SELECT item_id, 'Item ' || item_id || ': ' || left(text, 40 - length('Item ' || item_id || ': ')) AS echo FROM benchmark""")
def ux_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UX-3: a model's answer as JSON of a schema: the offline model says what it was asked."""
    prompt = F.concat(F.lit("Item "), F.col("item_id").cast("string"), F.lit(": "), "text")
    return Tables(spark, sf_dir).benchmark.select("item_id", models.structured(prompt, "echo string", models.mock)["echo"].alias("echo"))


@query(r"""WITH m AS (SELECT conv_id AS topic, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, left(text, 500) AS t FROM conversations),
p AS (SELECT topic, string_agg('- ' || t, chr(10) ORDER BY n) AS prompt FROM m WHERE n <= 10 GROUP BY 1),
s AS (SELECT topic, prompt, list_filter(list_transform(string_split(regexp_replace(prompt, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM p)
SELECT topic, sha256(CASE WHEN len(s) <= 2 THEN prompt ELSE s[1] || ' ... [Distilled] ... ' || s[-1] END) AS reflection FROM s""")
def ux_reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UX-5: reflections on the last ten turns of each conversation, by the heuristic."""
    m = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("topic"), F.col("turn").alias("at"), F.col("turn").alias("id"), "text")
    return models.reflect(m).select("topic", F.sha2("reflection", 256).alias("reflection"))


@query("SELECT doc_id, 1::BIGINT AS chunks, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n_chars FROM documents WHERE length(text) <= 1000 AND NOT regexp_matches(text, '\\n') AND NOT contains(text, '```') AND NOT starts_with(text, '#') AND regexp_matches(text, '\\S')")
def ux_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UX-8: the chunker as a table function in SQL, on documents of one line, which are a chunk each."""
    spark.udtf.register("lorekeep_chunks", chunking.chunk_udtf())
    d = Tables(spark, sf_dir).documents.filter("length(text) <= 1000 AND NOT contains(text, '\n') AND NOT contains(text, '```') AND NOT startswith(text, '#') AND text RLIKE '\\\\S'")
    cut = spark.sql("SELECT d.doc_id, c.ordinal, c.text FROM {d} AS d, LATERAL lorekeep_chunks('x.md', d.text) AS c", d=d)
    return cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("n_chars"))


_ALTERED = f"qx AS (SELECT item_id, array_to_string(list_transform({TOKENS.format('text')}, lambda x, i: CASE WHEN i % 2 = 0 THEN 'zz' || i ELSE x END), ' ') AS text FROM benchmark), "


@query(_ranked(items="qx", first=_ALTERED) + """,
e AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
f AS (SELECT query_id, min(pos) AS rank FROM r JOIN e USING (query_id, chunk_id) WHERE pos <= 5 GROUP BY 1),
cs AS (SELECT coalesce(rank <= 1, false) AS hit1, coalesce(rank <= 5, false) AS hit5, coalesce(1.0::DOUBLE / rank, 0) AS rr FROM (SELECT DISTINCT query_id FROM e) LEFT JOIN f USING (query_id))
SELECT round(avg(hit1::INT::DOUBLE), 6) AS hit1, round(avg(hit5::INT::DOUBLE), 6) AS hit5, round(avg(rr), 6) AS mrr, count(*) AS cases, avg(hit1::INT::DOUBLE) >= 0.8 AND avg(hit5::INT::DOUBLE) >= 0.9 AS passed FROM cs""")
def ev_altered_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV-1, EV-2, AG-10: the gate for queries of which every second word is replaced by one that no text has."""
    t = Tables(spark, sf_dir)
    words = F.transform(T.tokens(F.col("text")), lambda x, i: F.when((i + 1) % 2 == 0, F.concat(F.lit("zz"), (i + 1).cast("string"))).otherwise(x))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))
    found = memory_of(t).search(asked, stamp("2024-02-01"), SearchOptions(limit=5, compress=False))
    scored = readiness.evaluate(found.select("query_id", "pos", F.col("chunk_id").alias("source_file")), expected(t))
    made = readiness.gate(readiness.summary(scored))
    return made.select(F.round("hit1", 6).alias("hit1"), F.round("hit5", 6).alias("hit5"), F.round("mrr", 6).alias("mrr"), "cases", "passed")


# Word lists on texts that hold them.
def _put(words: list[str], key: Column) -> Column:
    """A row's whole text after the word of a list that its key picks."""
    return F.concat(F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int")), F.lit(" "), F.col("text"))


def _put_sql(words: list[str], key: str) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"([{quoted}])[({key}) % {len(words)} + 1] || ' ' || text"


def _count(words, text: str = "t") -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


EMOTION = [w for v in vocab.EMOTION_WORDS.values() for w in v]
KINDS = [w for v in vocab.CATEGORY_WORDS.values() for w in v] + ["plain"]
TASKS = ["Debug the", "explain", "refactor", "how to", "summarize", "plain", "System", "Parse error", "patch", "why", "docker step", "fail"]
DOMAIN = [w for v in vocab.DOMAIN_WORDS.values() for w in v]
_TURN = "conv_id * 7 + turn"
_NAMED = {k: f"({_count(v)} / {len(v)}.0::DOUBLE)" for k, v in vocab.EMOTION_WORDS.items()}


@query(f"WITH c AS (SELECT conv_id, turn, lower({_put_sql(EMOTION, _TURN)}) AS t FROM conversations) SELECT conv_id, turn, {', '.join(f'round({v}, 6) AS {k}' for k, v in _NAMED.items())} FROM c")
def ep_listed_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-2, AG-24: the real lists of emotions."""
    e = episodes.emotions(_put(EMOTION, F.col("conv_id") * 7 + F.col("turn")))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", *[F.round(v, 6).alias(k) for k, v in e.items()])


@query(f"WITH c AS (SELECT conv_id, turn, lower({_put_sql(KINDS, _TURN)}) AS t FROM conversations) SELECT conv_id, turn, CASE {' '.join(f'WHEN {_count(v)} > 0 THEN {chr(39)}{k}{chr(39)}' for k, v in vocab.CATEGORY_WORDS.items())} ELSE 'episodic' END AS category FROM c")
def ep_listed_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-1: the real lists of categories."""
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", T.category(_put(KINDS, F.col("conv_id") * 7 + F.col("turn"))).alias("category"))


@query(f"""WITH c AS (SELECT doc_id, lower({_put_sql(TASKS, 'doc_id')}) AS t FROM documents)
SELECT doc_id, CASE WHEN {_count(["code", "script", "debug", "error", "refactor", "build"])} > 0 THEN 'coding' WHEN {_count(["explain", "research", "what is", "why", "how does"])} > 0 THEN 'research' ELSE 'general' END AS task,
  CASE WHEN {_count(["how to", "step", "code", "fix", "debug"])} > 0 THEN 'coding' ELSE 'research' END AS profile,
  concat_ws('|', CASE WHEN {_count(["error", "fail"])} > 0 THEN 'Identified error pattern requiring structural patch.' END, CASE WHEN contains(t, 'docker') THEN 'Docker environments require port mapping verification.' END, CASE WHEN contains(t, 'step') THEN 'Sequence of operations detected.' END) AS lessons FROM c""")
def tx_listed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-18, SC-21, SC-23, SC-28: task, profile and lessons of whole documents that state a task."""
    t = _put(TASKS, F.col("doc_id"))
    return Tables(spark, sf_dir).documents.select("doc_id", T.task_type(t).alias("task"), T.compression_profile(T.intent(t)).alias("profile"), F.array_join(T.lessons(t), "|").alias("lessons"))


@query(f"WITH c AS (SELECT conv_id, turn, lower({_put_sql(DOMAIN, _TURN)}) AS t FROM conversations) " + " UNION ALL ".join(
    f"SELECT conv_id AS entity_id, turn AS memory_id, '{k}' AS trait_id, '{d}' AS domain_id, round(least(1, {_count(w)} / {len(w)}.0::DOUBLE * {f}), 6) AS strength, {_count(w)}::INT AS matched FROM c WHERE {_count(w)} > 0"
    for k, d, w, f in [*((f"domain_{d}", d, w, 2.0) for d, w in vocab.DOMAIN_WORDS.items()), *((t, "core_traits", w, 2.5) for t, w in vocab.TRAIT_WORDS.items())]))
def id_listed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-1: the real lists of domains and traits."""
    c = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("memory_id"), _put(DOMAIN, F.col("conv_id") * 7 + F.col("turn")).alias("text"), F.col("turn").alias("detected_at"))
    return identity.evidence(c).select("entity_id", "memory_id", "trait_id", "domain_id", F.round("strength", 6).alias("strength"), F.col("matched").cast("int").alias("matched"))


@query(r"""WITH n AS (SELECT 'Daily/' || conv_id || '-' || turn || '.md' AS id, list_transform(list_filter(string_split(text, chr(10)), lambda x, i: i > 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l, contains(lower(text), 'das') AS das, contains(lower(text), 'les') AS les FROM conversations)
SELECT id, array_to_string(l, '|') AS lessons, concat_ws(',', CASE WHEN das THEN 'Das' END, CASE WHEN les THEN 'Les' END) AS participants FROM n""")
def ep_daily_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-9: turns as daily notes whose lines after the first are bullets: lessons and participants of each."""
    c = Tables(spark, sf_dir).conversations
    notes = c.select(F.format_string("Daily/%d-%d.md", "conv_id", "turn").alias("path"), F.regexp_replace("text", "\n", "\n- ").alias("body"))
    return vault_jobs.daily_memories(notes, ("Das", "Les")).select("id", F.array_join("lessons", "|").alias("lessons"), F.array_join("participants", ",").alias("participants"))
