"""Episodes: conversation turns are episodic memories, documents notes.  The corpus is invented, so its
frequent tokens stand in for the word lists where a query would else give zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import vocab
from ..operators import episodes as E
from .base import Tables, query

WORDS = {"frustration": ("the", "and"), "excitement": ("that", "for", "with"), "confidence": ("die", "der", "und"), "stress": ("les", "des"), "satisfaction": ("que", "los", "las")}
GOALS = ("the", "la", "el", "un", "ich")
KINDS = {"goal": ("ingin", "theat"), "procedural": ("keit", "ung"), "reflection": ("ción", "mente"), "relationship": ("eaux", "elle"), "identity": ("sh", "th")}


def _hits(words: tuple[str, ...], text: str = "lower(text)") -> str:
    return " + ".join(f"contains({text}, '{w}')::INT" for w in words)


EMO = {k: f"(({_hits(v)}) / {len(v)}.0::DOUBLE)" for k, v in WORDS.items()}
MEAN = f"(({' + '.join(EMO.values())}) / 5.0::DOUBLE)"


@query(f"SELECT conv_id, turn, {', '.join(f'round({v}, 6) AS {k}' for k, v in EMO.items())}, round({MEAN}, 6) AS intensity, CASE {' '.join(f'WHEN {v} = greatest({', '.join(EMO.values())}) THEN {chr(39)}{k}{chr(39)}' for k, v in EMO.items())} END AS dominant FROM conversations")
def ep_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-2, AG-24."""
    e = E.emotions(F.col("text"), WORDS)
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", *[F.round(v, 6).alias(k) for k, v in e.items()], F.round(E.intensity(list(e.values())), 6).alias("intensity"), E.dominant(e).alias("dominant"))


@query(f"SELECT conv_id, turn, CASE {' '.join(f'WHEN ({_hits(v)}) > 0 THEN {chr(39)}{k}{chr(39)}' for k, v in KINDS.items())} ELSE 'episodic' END AS category FROM conversations")
def ep_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-1."""
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", T.category(F.col("text"), KINDS).alias("category"))


PLAIN = ", ".join(f"'{w}'" for w in vocab.PLAIN_WORDS)
COMMON = ", ".join(f"'{w}'" for w in vocab.COMMON_WORDS)
OWN = r"list_distinct(regexp_extract_all(lower(text), '[^\s]+'))"
FOUND = r"list_distinct(regexp_extract_all(lower(text), '\b[a-z]{2,}\b'))"
GOAL = f"least(1, ({_hits(GOALS)}) / 5.0::DOUBLE * 2)"


@query(f"""SELECT conv_id, turn, round(greatest(0, least(1, {MEAN} * 0.3 + least(1, len(list_filter({OWN}, lambda x: x NOT IN ({PLAIN}))) / greatest(len({OWN}), 1)::DOUBLE * 3) * 0.2
  + {GOAL} * 0.3 + least(1, turn / 5.0::DOUBLE) * 0.2)), 4) AS importance FROM conversations""")
def ep_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-3."""
    c = Tables(spark, sf_dir).conversations
    return c.select("conv_id", "turn", E.importance_a(F.regexp_replace("text", r"\s+", " "), F.col("turn"), WORDS, GOALS).alias("importance"))


@query(f"""SELECT event_id, round(least(1, len(list_filter(w, lambda x: x NOT IN ({COMMON}))) / len(w)::DOUBLE * 1.5), 6) AS novelty
FROM (SELECT item_id AS event_id, list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), '[a-z]{{2,}}')) AS w FROM benchmark) WHERE len(w) > 0""")
def ep_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-4."""
    b = Tables(spark, sf_dir).benchmark.withColumn("t", F.regexp_replace(F.lower("text"), "[^a-z ]", " "))
    return b.select(F.col("item_id").alias("event_id"), F.round(E.novelty(F.col("t")), 6).alias("novelty"))


@query(f"""WITH v AS (SELECT list_distinct(flatten(list(regexp_extract_all(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), '[a-z]{{2,}}')))) AS vocabulary FROM conversations),
w AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^a-z ]', ' ', 'g'), '[a-z]{{2,}}')), lambda x: x NOT IN ({COMMON})) AS w FROM benchmark),
k AS (SELECT DISTINCT unnest(vocabulary) AS t FROM v), e AS (SELECT item_id, unnest(w) AS t FROM w)
SELECT item_id, count(*) AS significant, count(*) FILTER (WHERE t NOT IN (SELECT t FROM k)) AS novel FROM e GROUP BY 1""")
def ep_corpus_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-4, AG-23: words new to the corpus; the vocabulary stays a table and is joined."""
    t = Tables(spark, sf_dir)
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z ]", " ")
    vocabulary = t.conversations.select(F.explode(F.regexp_extract_all(plain("text"), F.lit("([a-z]{2,})"), F.lit(1))).alias("t")).distinct().withColumn("known", F.lit(1))
    own = t.benchmark.select("item_id", F.explode(E.significant(plain("text"))).alias("t"))
    return own.join(vocabulary, "t", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("significant"), F.count_if(F.col("known").isNull()).alias("novel"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0.25 WHEN k = 'x.episodic' THEN 0.3 WHEN k = 'x.reflection' THEN 0.4 ELSE 0.0 END::DOUBLE AS threshold
FROM (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN 'x.episodic' WHEN 1 THEN 'x.reflection' ELSE 'x.goal' END AS k FROM customer)""")
def ep_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-5, EP-14."""
    n = F.col("c_nationkey")
    k = F.when(n == 0, None).when(n % 3 == 0, "X.Episodic").when(n % 3 == 1, "x.reflection").otherwise("x.goal")
    return Tables(spark, sf_dir).customer.select("c_custkey", E.threshold(k).alias("threshold"))


SCORED = """s AS (SELECT conv_id * 100 + turn AS id, role AS event_type, CASE WHEN turn % 3 = 0 THEN ['zed', 'amy', 'bob', 'cat'] WHEN turn % 3 = 1 THEN [role] ELSE [] END AS participants,
  CASE WHEN length(text) % 2 = 0 THEN 'web' ELSE 'cli' END AS platform, [left(text, 3)] AS lessons, (length(text) % 100) / 100.0::DOUBLE AS score FROM conversations),
k AS (SELECT *, CASE WHEN len(participants) > 0 THEN event_type || ':' || list_aggregate(list_sort(participants[1:3]), 'string_agg', '|') ELSE event_type END AS cluster_key FROM s)"""


def scored_of(t: Tables) -> DataFrame:
    n = F.length("text")
    people = F.when(F.col("turn") % 3 == 0, F.array(*map(F.lit, ("zed", "amy", "bob", "cat")))).when(F.col("turn") % 3 == 1, F.array("role")).otherwise(F.array().cast("array<string>"))
    s = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("event_type"), people.alias("participants"), F.when(n % 2 == 0, "web").otherwise("cli").alias("platform"),
        F.array(F.substring("text", 1, 3)).alias("lessons"), ((n % 100) / 100.0).alias("score"), "text",
    )
    return s.withColumn("cluster_key", E.cluster_key(F.lit(""), F.col("event_type"), F.col("participants")))


@query(f"""WITH {SCORED}, g AS (SELECT cluster_key, round(avg(score), 4) AS avg_importance, count(*) AS n, count(*) >= 3 AS promoted, string_agg(DISTINCT platform, ',' ORDER BY platform) AS tools FROM k GROUP BY 1),
p AS (SELECT cluster_key, string_agg(DISTINCT p, ',' ORDER BY p) AS participants FROM (SELECT cluster_key, unnest(participants) AS p FROM k) GROUP BY 1)
SELECT g.*, coalesce(p.participants, '') AS participants FROM g LEFT JOIN p USING (cluster_key)""")
def ep_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11, AG-12, AG-14, EP-8, TK-12."""
    c = E.clusters(scored_of(Tables(spark, sf_dir)))
    return c.select("cluster_key", "avg_importance", F.col("count").alias("n"), "promoted", F.array_join("tools", ",").alias("tools"), F.array_join("participants", ",").alias("participants"))


@query(f"WITH {SCORED} SELECT cluster_key, arg_max(id, (score, -id)) AS keeper, count(*) - 1 AS pruned FROM k GROUP BY 1")
def ep_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-13."""
    return E.keepers(scored_of(Tables(spark, sf_dir)))


@query(f"WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (WHERE score >= 0.3) AS retained, count(*) FILTER (WHERE score < 0.3) AS pruned, count(DISTINCT cluster_key) AS clusters, round(count(*) FILTER (WHERE score >= 0.3) / count(*)::DOUBLE * 100, 0) AS retention_rate FROM k")
def ep_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-15, EP-7."""
    return E.retention(scored_of(Tables(spark, sf_dir)).withColumn("threshold", F.lit(0.3)))


@query("""WITH a AS (SELECT event_id, date_diff('day', ts::DATE, DATE '2024-02-01') AS age, value / 200 AS i, CASE event_type WHEN 'view' THEN 'distilled' WHEN 'click' THEN 'summarized' ELSE 'raw' END AS st FROM events)
SELECT event_id, concat_ws(',', CASE WHEN age > 14 AND i < 0.3 AND st <> 'distilled' THEN 'archive' END, CASE WHEN NOT (age > 14 AND i < 0.3 AND st <> 'distilled') AND age > 2 AND st = 'raw' THEN 'summarize' END,
  CASE WHEN NOT (age > 14 AND i < 0.3 AND st <> 'distilled') AND i >= 0.75 AND st <> 'distilled' THEN 'promote' END) AS actions FROM a""")
def ep_distill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-10."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "distilled").when(kind == "click", "summarized").otherwise("raw")
    age = F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("ts"))
    return Tables(spark, sf_dir).events.select("event_id", F.array_join(E.distill_actions(age, F.col("value") / 200, state), ",").alias("actions"))


@query("""WITH r AS (SELECT DISTINCT doc_id AS note, unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS entity FROM documents)
SELECT entity, count(*) AS notes FROM r WHERE entity NOT IN (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) FROM benchmark) GROUP BY 1 HAVING count(*) >= 2""")
def ep_promoted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-11, AG-16, JN-24: capitalised words are entities, those in benchmark have notes."""
    t = Tables(spark, sf_dir)
    words = lambda: F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{6,})"), F.lit(1))).alias("entity")
    return E.promoted_entities(t.documents.select(F.col("doc_id").alias("note"), words()), t.benchmark.select(words()).distinct())


NOTE = """(CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'type: note' || chr(10) || 'date: 2024-01-01' || chr(10) || '---' || chr(10) WHEN 1 THEN '# Head' || chr(10) || '- item [[' || source || ']]' || chr(10) WHEN 2 THEN '```' || chr(10) || '```' || chr(10) ELSE '' END || text)"""


def notes_of(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 4
    head = F.when(m == 0, "---\ntype: note\ndate: 2024-01-01\n---\n").when(m == 1, F.concat(F.lit("# Head\n- item [["), "source", F.lit("]]\n"))).when(m == 2, "```\n```\n").otherwise("")
    return t.documents.select("doc_id", F.concat(head, "text").alias("raw"), "source", "text")


@query(rf"""WITH n AS (SELECT doc_id, {NOTE} AS raw FROM documents),
p AS (SELECT doc_id, raw, doc_id % 4 = 0 AS fm, CASE WHEN doc_id % 4 = 0 THEN raw[length('---' || chr(10) || 'type: note' || chr(10) || 'date: 2024-01-01' || chr(10) || '---' || chr(10)) + 1:] ELSE raw END AS body FROM n),
q AS (SELECT *, len(regexp_extract_all(body, '[^\s]+')) AS w, len(regexp_extract_all(raw, '\[\[(.*?)\]\]')) AS lk, regexp_matches(body, '(?m)^#{{1,3}}\s+') AS h, regexp_matches(body, '(?m)^[-*]\s+') AS b, len(regexp_extract_all(body, '```')) >= 2 AS c FROM p),
s AS (SELECT *, greatest(0, least(1, (CASE WHEN fm THEN 2.5 ELSE 0 END + CASE WHEN lk >= 1 THEN least(1.5, lk * 0.3::DOUBLE) ELSE 0 END + CASE WHEN h THEN 0.5 ELSE 0 END + CASE WHEN b THEN 0.5 ELSE 0 END + CASE WHEN c THEN 0.5 ELSE 0 END
  + CASE WHEN w BETWEEN 50 AND 1500 THEN 1.0 WHEN w < 20 THEN 0 ELSE 0.3 END - CASE WHEN w > 300 AND NOT h THEN 1 ELSE 0 END)::DOUBLE / 10)) AS sc FROM q)
SELECT doc_id, round(sc, 3) AS score, CASE WHEN sc >= 0.8 THEN 'A' WHEN sc >= 0.6 THEN 'B' WHEN sc >= 0.4 THEN 'C' WHEN sc >= 0.2 THEN 'D' ELSE 'F' END AS grade, w::INT AS word_count FROM s""")
def ep_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-12: notes with front matter, headings or fences in front of a document."""
    return notes_of(Tables(spark, sf_dir)).select("doc_id", E.quality(F.col("raw")).alias("q")).select("doc_id", "q.score", "q.grade", "q.word_count")


@query(rf"""WITH n AS (SELECT doc_id, {NOTE} AS raw, text FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN NOT starts_with(raw, '---') THEN 'MISSING_FRONTMATTER' END, CASE WHEN doc_id % 3 = 0 THEN 'MISSING_EXPLICIT_MEMORY_ID' END, CASE WHEN doc_id % 3 = 1 THEN 'INVALID_MEMORY_ID' END,
  CASE WHEN doc_id % 4 <> 0 THEN 'MISSING_TYPE' END, CASE WHEN doc_id % 4 = 0 THEN 'NON_STANDARD_TYPE' END,
  CASE WHEN NOT regexp_matches(raw, '\[\[(.*?)\]\]') AND len(regexp_extract_all(text, '[^\s]+')) > 50 THEN 'ORPHAN_CONTENT' END, CASE WHEN NOT contains(text, '# ') AND trim(text) <> '' THEN 'MISSING_TITLE_HEADER' END) AS issues FROM n""")
def ep_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-13."""
    i = F.col("doc_id")
    mid = F.when(i % 3 == 0, None).when(i % 3 == 1, "not-a-uuid").otherwise("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    found = E.issues(F.col("raw"), F.lit(None).cast("string"), mid, F.when(i % 4 == 0, "note"), F.col("text"))
    return notes_of(Tables(spark, sf_dir)).select("doc_id", F.array_join(F.transform(found, lambda x: x["code"]), ",").alias("issues"))


@query("""WITH i AS (SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['a', 'b'] ELSE ['b'] END) AS code FROM documents)
SELECT 'warning' AS severity, code, count(*) AS n, count(DISTINCT doc_id) AS notes FROM i GROUP BY 1, 2""")
def ep_issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21."""
    one = lambda c: F.struct(F.lit(c).alias("code"), F.lit("warning").alias("severity"))
    d = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.array(one("a"), one("b"))).otherwise(F.array(one("b"))).alias("issues"))
    return E.issue_totals(d)


@query("SELECT doc_id AS path, source AS target FROM documents WHERE doc_id % 4 = 1 AND source NOT IN (SELECT 'src' || n_regionkey FROM nation)")
def ep_unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-23."""
    t = Tables(spark, sf_dir)
    known = t.nation.select(F.concat(F.lit("src"), F.col("n_regionkey").cast("string")).alias("name"))
    return E.unresolved_links(notes_of(t).withColumnRenamed("doc_id", "path"), known).select("path", "target")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'goal' ELSE 'episodic' END AS category, role = 'user' AS has_goal, (length(text) % 100) / 100.0::DOUBLE AS importance FROM conversations")
def ep_typed_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-6, PRJ-13."""
    kind = F.when(F.col("role") == "user", "goal").otherwise("episodic")
    m = E.typed(kind, F.col("text"), F.lit("2024-01-01"), (F.length("text") % 100) / 100.0)
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", "m.category", F.col("m.goal").isNotNull().alias("has_goal"), "m.importance")


@query("SELECT event_id, round(greatest(0, least(1, (0.5 + least((event_id % 9) * 0.05::DOUBLE, 0.3)) * pow(0.5, (event_id % 60) / 30.0::DOUBLE))), 6) AS importance FROM events")
def ep_aged_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-9."""
    i = F.col("event_id")
    return Tables(spark, sf_dir).events.select("event_id", F.round(S.aged_importance(F.lit(0.5), i % 9, i % 60), 6).alias("importance"))
