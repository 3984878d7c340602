"""Identity: users are entities, conversation turns and events evidence; short invented word lists stand in for the real ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import identity as I
from .base import Tables, query

DOMAINS = {"core_traits": ("the", "und", "que"), "values": ("ing", "keit", "mente")}
TRAITS = {"systems_thinker": ("tion", "ción"), "deadline_driver": ("eaux", "elle", "ent")}


def _n(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + ")"


EVIDENCE = "ev AS (" + " UNION ALL ".join(
    f"SELECT conv_id, turn, '{k}' AS trait_id, '{d}' AS domain_id, least(1, {_n(w)} / {len(w)}.0::DOUBLE * {f}) AS strength, {_n(w)} AS matched FROM conversations WHERE {_n(w)} > 0"
    for k, d, w, f in [*((f"domain_{d}", d, w, 2.0) for d, w in DOMAINS.items()), *((t, "core_traits", w, 2.5) for t, w in TRAITS.items())]
) + ")"


@query(f"WITH {EVIDENCE} SELECT conv_id AS entity_id, turn AS memory_id, trait_id, domain_id, round(strength, 6) AS strength, matched::INT AS matched FROM ev")
def id_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-1."""
    c = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("memory_id"), "text", F.col("turn").alias("detected_at"))
    return I.evidence(c, DOMAINS, TRAITS).select("entity_id", "memory_id", "trait_id", "domain_id", F.round("strength", 6).alias("strength"), F.col("matched").cast("int").alias("matched"))


#: A trait of a user is an event type; strength is the value by 200; there are two domains.
FOUND = """e AS (SELECT user_id AS entity_id, CASE event_type WHEN 'error' THEN 'frustration_trigger' WHEN 'click' THEN 'excitement_trigger' WHEN 'view' THEN 'risk_averse' WHEN 'signup' THEN 'risk_tolerant' ELSE 'autonomous' END AS trait_id,
  CASE WHEN event_type IN ('error', 'click') THEN 'emotional_patterns' ELSE 'core_traits' END AS domain_id, least(1, value / 60) AS strength, ts, event_id FROM events),
g AS (SELECT entity_id, trait_id, min(domain_id) AS domain_id, count(*) AS n, round(avg(strength), 4) AS initial, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS span, list(strength ORDER BY ts, event_id) AS ss FROM e GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT *, CASE WHEN trait_id = 'autonomous' THEN 'core' WHEN contains(trait_id, 'trigger') THEN 'temporary' ELSE 'adaptive' END AS category FROM g),
st AS (SELECT *, round(least(1, (least(1, n / 5.0::DOUBLE) * 0.5 + least(1, span / 90) * 0.3 + (CASE WHEN span > 0 THEN n / greatest(span / 30, 1) ELSE n END) * 0.2) * CASE category WHEN 'core' THEN 1.2 WHEN 'temporary' THEN 0.4 ELSE 0.7 END), 4) AS stability,
  round(initial, 4) AS confidence FROM k)"""


def found_of(t: Tables) -> DataFrame:
    k = F.col("event_type")
    trait = F.when(k == "error", "frustration_trigger").when(k == "click", "excitement_trigger").when(k == "view", "risk_averse").when(k == "signup", "risk_tolerant").otherwise("autonomous")
    domain = F.when(k.isin("error", "click"), "emotional_patterns").otherwise("core_traits")
    return t.events.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("memory_id"), trait.alias("trait_id"), domain.alias("domain_id"), F.least(F.lit(1.0), F.col("value") / 60).alias("strength"), F.col("ts").alias("detected_at"))


def traits_of(t: Tables) -> DataFrame:
    """Traits with their initial confidence (the fold is ``id_fold``)."""
    return I.traits(found_of(t)).withColumn("confidence", F.col("initial"))


@query(f"WITH {FOUND} SELECT entity_id, trait_id, domain_id, n AS evidence_count, initial, category, stability FROM st")
def id_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-2, ID-5, AG-17, AG-18."""
    return I.traits(found_of(Tables(spark, sf_dir))).select("entity_id", "trait_id", "domain_id", "evidence_count", "initial", "category", "stability")


@query()
def id_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-3, WN-5: an ordered fold over a trait's evidence.

    No SQL: each step rounds to four decimals, and engines break binary ties
    differently; hand-computed folds are in the tests, ``id_smooth_fold`` has SQL."""
    return I.traits(found_of(Tables(spark, sf_dir))).select("entity_id", "trait_id", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH RECURSIVE {FOUND}, w AS (SELECT entity_id, trait_id, ss, 0 AS i, list_sum(ss) / len(ss) AS c, 0.0::DOUBLE AS total FROM g
  UNION ALL SELECT entity_id, trait_id, ss, i + 1, greatest(0, least(1, c * 0.7::DOUBLE + (total + ss[i + 1]) / (i + 1) * 0.3::DOUBLE)), total + ss[i + 1] FROM w WHERE i < len(ss))
SELECT entity_id, trait_id, round(c, 6) AS confidence FROM w WHERE i = len(ss)""")
def id_smooth_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-3, WN-5: the fold without rounding, from the plain mean on."""
    s = I.strengths(found_of(Tables(spark, sf_dir))).filter("size(strengths) >= 2")
    mean = F.aggregate("strengths", F.lit(0.0), lambda a, x: a + x) / F.size("strengths")
    return s.select("entity_id", "trait_id", F.round(I.fold(mean, F.col("strengths"), None), 6).alias("confidence"))


@query(f"""WITH {FOUND}, d AS (SELECT *, entity_id % 60 AS days, CASE category WHEN 'core' THEN 0.001 WHEN 'temporary' THEN 0.03 ELSE 0.01 END::DOUBLE AS rate FROM st),
x AS (SELECT *, CASE WHEN days > 0 THEN greatest(0.2, confidence - rate * days) ELSE confidence END AS c FROM d)
SELECT entity_id, trait_id, round(CASE WHEN c < 0.15 THEN 0 ELSE c END, 6) AS confidence, n >= CASE category WHEN 'core' THEN 10 WHEN 'temporary' THEN 1 ELSE 3 END AS reinforced, round(greatest(0.15, confidence - 0.15), 6) AS suppressed,
  CASE WHEN confidence >= 0.2 THEN 'active' WHEN confidence < 0.15 AND confidence > 0 THEN 'dormant' ELSE 'inactive' END AS activity FROM x""")
def id_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-4, ID-6."""
    t = traits_of(Tables(spark, sf_dir))
    c, k = F.col("confidence"), F.col("category")
    return t.select("entity_id", "trait_id", F.round(I.decayed(c, k, F.col("entity_id") % 60), 6).alias("confidence"), I.reinforced(F.col("evidence_count"), k).alias("reinforced"), F.round(I.suppressed(c), 6).alias("suppressed"), I.activity(c).alias("activity"))


@query(f"WITH {FOUND} SELECT entity_id, round(avg(confidence), 4) AS global_confidence FROM st WHERE confidence >= 0.2 GROUP BY 1")
def id_global_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-19."""
    return I.global_confidence(traits_of(Tables(spark, sf_dir)))


CONTRA = f"""{FOUND}, o(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in vocab.OPPOSITES)}),
kc AS (SELECT x.entity_id, a AS trait_a, b AS trait_b, round(least(x.confidence, y.confidence) * 0.5, 6) AS severity FROM o JOIN st x ON x.trait_id = a JOIN st y ON y.trait_id = b AND y.entity_id = x.entity_id WHERE x.confidence >= 0.4 AND y.confidence >= 0.4)"""


@query(f"WITH {CONTRA} SELECT entity_id, trait_a, trait_b, severity FROM kc")
def id_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-7, JN-25."""
    return I.known_contradictions(traits_of(Tables(spark, sf_dir))).select("entity_id", "trait_a", "trait_b", F.round(F.least("confidence_a", "confidence_b") * 0.5, 6).alias("severity"))


@query(f"""WITH {CONTRA}, h AS (SELECT entity_id, t AS trait_id, count(*) AS n FROM (SELECT entity_id, unnest([trait_a, trait_b]) AS t FROM kc) GROUP BY 1, 2)
SELECT st.entity_id, st.trait_id, coalesce(h.n, 0) AS contradictions, round(greatest(0, confidence - coalesce(h.n, 0) * 0.075::DOUBLE), 6) AS confidence FROM st LEFT JOIN h USING (entity_id, trait_id)""")
def id_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-7."""
    t = traits_of(Tables(spark, sf_dir))
    return I.penalised(t, I.known_contradictions(t)).select("entity_id", "trait_id", "contradictions", F.round("confidence", 6).alias("confidence"))


@query("""WITH t AS (SELECT conv_id AS entity_id, role AS trait_id, lower(text) AS x FROM conversations),
p AS (SELECT a.entity_id, a.trait_id AS trait_a, b.trait_id AS trait_b, (regexp_matches(a.x, 'the.*and') AND regexp_matches(b.x, 'die.*und'))::INT + (regexp_matches(a.x, 'de') AND regexp_matches(b.x, 'la'))::INT AS h FROM t a JOIN t b ON a.entity_id = b.entity_id AND a.trait_id < b.trait_id)
SELECT entity_id, trait_a, trait_b, round(least(1, sum(h) / (count(*) * 2.0::DOUBLE) * 2), 4) AS severity FROM p GROUP BY 1, 2, 3 HAVING sum(h) > 0""")
def id_text_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-8, JN-26."""
    c = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("entity_id"), F.col("role").alias("trait_id"), "text")
    t = c.select("entity_id", "trait_id").distinct().withColumn("domain_id", F.lit("core_traits")).withColumn("confidence", F.lit(0.5))
    found = I.text_contradictions(t, c, [("the.*and", "die.*und"), ("de", "la")])
    return found.select("entity_id", "trait_a", "trait_b", F.round("severity", 4).alias("severity"))


WEIGHTS = f"""{FOUND}, wt AS (SELECT entity_id, trait_id, stability, confidence, greatest(0, least(1, CASE category WHEN 'core' THEN 0.9 WHEN 'temporary' THEN 0.15 ELSE 0.4 END::DOUBLE * CASE domain_id WHEN 'core_traits' THEN 1.2 ELSE 0.55 END::DOUBLE * (0.5 * stability + 0.5 * confidence))) AS w FROM st WHERE confidence >= 0.1)"""


@query(f"WITH {WEIGHTS} SELECT entity_id, trait_id, round(w, 4) AS reasoning, round(w * 0.9, 4) AS retrieval, round(w * 0.85, 4) AS planning, round(w * 0.7, 4) AS emotional FROM wt")
def id_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-10, TK-11."""
    w = I.weights(traits_of(Tables(spark, sf_dir)))
    return w.select("entity_id", "trait_id", "reasoning", "retrieval", "planning", "emotional")


@query(f"WITH {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY stability DESC, confidence DESC, trait_id) AS pos FROM st WHERE confidence >= 0.3) SELECT entity_id, trait_id, pos FROM r WHERE pos <= 5")
def id_top_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-10, ID-12."""
    return I.top_traits(traits_of(Tables(spark, sf_dir))).select("entity_id", "trait_id", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH {WEIGHTS}, q AS (SELECT conv_id * 10 + turn AS query_id, conv_id AS entity_id, lower(text) AS t FROM conversations), tg(tag, trait_id) AS (VALUES ('the', 'autonomous'), ('und', 'risk_averse'), ('que', 'risk_tolerant'), ('de', 'autonomous'))
SELECT query_id, round(0.1::DOUBLE * sum(round(w * 0.9, 4)), 4) AS identity_boost FROM (SELECT DISTINCT query_id, entity_id, trait_id FROM q JOIN tg ON contains(t, tag)) JOIN wt USING (entity_id, trait_id) GROUP BY 1""")
def id_retrieval_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET-24."""
    t = Tables(spark, sf_dir)
    q = t.conversations.select((F.col("conv_id") * 10 + F.col("turn")).alias("query_id"), F.col("conv_id").alias("entity_id"), "text")
    tag = F.explode(F.array(*[F.struct(F.lit(a).alias("tag"), F.lit(b).alias("trait_id")) for a, b in (("the", "autonomous"), ("und", "risk_averse"), ("que", "risk_tolerant"), ("de", "autonomous"))])).alias("x")
    tags = q.select("entity_id").distinct().select("entity_id", tag).select("entity_id", "x.tag", "x.trait_id")
    return I.retrieval_boosts(q, I.weights(traits_of(t)), tags).withColumn("identity_boost", F.round("identity_boost", 4))


VERSIONS = "v AS (SELECT o_custkey % 200 AS entity_id, (o_orderkey % 3 + 1)::INT AS version_number, o_orderpriority AS trait_id, round(avg(o_totalprice) / 500000, 4) AS confidence FROM orders GROUP BY 1, 2, 3)"
DRIFT = f"""{VERSIONS}, m AS (SELECT entity_id, max(version_number) AS vt FROM v GROUP BY 1),
x AS (SELECT v.entity_id, vt, trait_id, max(confidence) FILTER (WHERE version_number < vt) AS b, max(confidence) FILTER (WHERE version_number = vt) AS a FROM v JOIN m USING (entity_id) WHERE version_number >= vt - 1 GROUP BY 1, 2, 3),
dr AS (SELECT entity_id, trait_id, round(a - b, 4) AS confidence_delta, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed' WHEN abs(round(a - b, 4)) > 0.1 THEN 'changed' END AS change FROM x WHERE vt > 1)"""


def versions_of(t: Tables) -> DataFrame:
    key = [(F.col("o_custkey") % 200).alias("entity_id"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("version_number"), F.col("o_orderpriority").alias("trait_id")]
    return t.orders.groupBy(*key).agg(F.round(F.avg("o_totalprice") / 500000, 4).alias("confidence"))


@query(f"WITH {DRIFT} SELECT entity_id, trait_id, confidence_delta, change FROM dr WHERE change IS NOT NULL")
def id_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-11, JN-27, WN-4."""
    return I.drift(versions_of(Tables(spark, sf_dir))).select("entity_id", "trait_id", "confidence_delta", "change")


@query(f"WITH {VERSIONS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY entity_id ORDER BY version_number DESC) AS n FROM v) SELECT entity_id, version_number, trait_id FROM r WHERE n <= 2")
def id_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-22, WN-10."""
    return I.snapshots(versions_of(Tables(spark, sf_dir)), 2).select("entity_id", "version_number", "trait_id")


@query(f"""WITH {DRIFT}, i AS (SELECT entity_id, trait_id, CASE change WHEN 'added' THEN 'new:' || trait_id WHEN 'removed' THEN 'removed:' || trait_id ELSE trait_id || CASE WHEN confidence_delta > 0 THEN ':up:' ELSE ':down:' END || printf('%.2f', abs(confidence_delta)) END AS i,
  row_number() OVER (PARTITION BY entity_id ORDER BY trait_id) AS p FROM dr WHERE change IS NOT NULL)
SELECT entity_id, string_agg(i, '; ' ORDER BY p) AS summary FROM i WHERE p <= 5 GROUP BY 1""")
def id_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-11."""
    return I.change_summary(I.drift(versions_of(Tables(spark, sf_dir))))


#: Other names and domains for the traits above, so that every part of an injection is told to someone.
TOLD = FOUND.replace("ELSE 'autonomous' END", "ELSE 'concise_communicator' END").replace(
    "CASE WHEN event_type IN ('error', 'click') THEN 'emotional_patterns' ELSE 'core_traits' END",
    "CASE event_type WHEN 'error' THEN 'motivations' WHEN 'click' THEN 'long_term_drives' WHEN 'view' THEN 'decision_patterns' WHEN 'signup' THEN 'decision_patterns' ELSE 'communication_style' END",
).replace("WHEN trait_id = 'autonomous' THEN 'core' ", "")


def told_of(t: Tables) -> DataFrame:
    trait = F.when(F.col("trait_id") == "autonomous", "concise_communicator").otherwise(F.col("trait_id"))
    domain = F.when(F.col("trait_id") == "frustration_trigger", "motivations").when(F.col("trait_id") == "excitement_trigger", "long_term_drives").when(F.col("trait_id").startswith("risk"), "decision_patterns").otherwise("communication_style")
    found = found_of(t).select("entity_id", "memory_id", trait.alias("trait_id"), domain.alias("domain_id"), "strength", "detected_at")
    return I.traits(found).withColumn("confidence", F.col("initial"))


_LABEL = "array_to_string(list_transform(string_split({0}, '_'), lambda x: upper(x[1]) || x[2:]), ' ')"


@query(f"""WITH {TOLD}, gc AS (SELECT entity_id, round(avg(confidence), 4) AS g FROM st WHERE confidence >= 0.2 GROUP BY 1),
p AS (SELECT entity_id, max(coalesce(g, 0)) AS g FROM (SELECT DISTINCT entity_id FROM st) LEFT JOIN gc USING (entity_id) GROUP BY 1),
w AS (SELECT entity_id, trait_id, round(round(greatest(0, least(1, CASE category WHEN 'temporary' THEN 0.15 ELSE 0.4 END::DOUBLE * CASE domain_id WHEN 'motivations' THEN 1.1 WHEN 'long_term_drives' THEN 1.1 WHEN 'decision_patterns' THEN 0.85 ELSE 0.8 END::DOUBLE * (0.5 * stability + 0.5 * confidence))) * 0.85, 4), 4) AS planning FROM st WHERE confidence >= 0.1),
top AS (SELECT entity_id, string_agg({_LABEL.format('trait_id')}, ', ' ORDER BY stability DESC, confidence DESC, trait_id) AS v FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY stability DESC, confidence DESC, trait_id) AS rn FROM st WHERE confidence >= 0.3) WHERE rn <= 3 GROUP BY 1),
sp AS (SELECT entity_id FROM st WHERE domain_id = 'communication_style' AND confidence >= 0.3),
de AS (SELECT entity_id, arg_min(trait_id, (-confidence, trait_id)) AS v FROM st WHERE domain_id = 'decision_patterns' AND confidence >= 0.3 GROUP BY 1),
dv AS (SELECT entity_id, string_agg({_LABEL.format('trait_id')}, ', ' ORDER BY confidence DESC, trait_id) AS v FROM st WHERE domain_id IN ('motivations', 'long_term_drives') AND confidence >= 0.3 GROUP BY 1),
pl AS (SELECT entity_id, string_agg(trait_id, ', ' ORDER BY planning DESC, trait_id) AS v FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY planning DESC, trait_id) AS n FROM w WHERE planning > 0.3) WHERE n <= 2 GROUP BY 1)
SELECT p.entity_id, concat_ws(chr(10), '[identity_injection entity=' || p.entity_id || ' v1]', CASE WHEN g >= 0.1 THEN '  Core identity: ' || top.v END,
  CASE WHEN g >= 0.1 AND sp.entity_id IS NOT NULL THEN '  Communication: concise' || chr(10) || '  Length: concise' END, CASE WHEN g >= 0.1 THEN '  Decision style: ' || de.v END,
  CASE WHEN g >= 0.1 THEN '  Drivers: ' || dv.v END, CASE WHEN g >= 0.1 THEN '  Planning focus: ' || pl.v END, '[/identity_injection]') AS text
FROM p LEFT JOIN top USING (entity_id) LEFT JOIN sp USING (entity_id) LEFT JOIN de USING (entity_id) LEFT JOIN dv USING (entity_id) LEFT JOIN pl USING (entity_id)""")
def id_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-12."""
    t = told_of(Tables(spark, sf_dir))
    who = t.select("entity_id").distinct().join(I.global_confidence(t), "entity_id", "left").fillna(0.0, ["global_confidence"]).withColumn("version", F.lit(1))
    return I.injection(t, I.weights(t), who).select("entity_id", "text")


@query(f"""WITH {EVIDENCE.replace('FROM conversations', "FROM (SELECT conv_id, turn, text || ' ' || role || ' talk' AS text FROM conversations)")},
o AS (SELECT * FROM ev WHERE turn < 3), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS shows FROM ev WHERE turn >= 3),
t AS (SELECT conv_id, trait_id, round(avg(strength), 4) AS c FROM o GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT n.* FROM n WHERE NOT starts_with(trait_id, 'domain_')),
ol AS (SELECT m.* FROM m SEMI JOIN t USING (conv_id, trait_id)), st AS (SELECT m.* FROM m ANTI JOIN t USING (conv_id, trait_id) WHERE strength >= 0.7 AND shows >= 2),
al AS (SELECT conv_id, trait_id, c FROM t UNION ALL SELECT conv_id, trait_id, arg_min(strength, turn) * 0.5 FROM st GROUP BY 1, 2),
ct AS (SELECT conv_id, trait_id, count(*) AS n FROM (SELECT conv_id, trait_id FROM o UNION ALL SELECT conv_id, trait_id FROM ol UNION ALL SELECT conv_id, trait_id FROM st) GROUP BY 1, 2)
SELECT conv_id AS entity_id, trait_id, round(c, 4) AS confidence, n AS evidence_count FROM al JOIN ct USING (conv_id, trait_id)""")
def id_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-13, ID-1 with tags and event type: later turns of a conversation are new memories."""
    c = Tables(spark, sf_dir).conversations.select(F.col("conv_id").alias("entity_id"), F.col("turn").alias("memory_id"), "text", F.array("role").alias("tags"), F.lit("talk").alias("event_type"), F.timestamp_seconds(F.col("turn")).alias("detected_at"))
    known = I.evidence(c.filter("memory_id < 3"), DOMAINS, TRAITS)
    have = I.traits(known).withColumn("confidence", F.col("initial"))
    made, _ = I.updated(have, known, c.filter("memory_id >= 3"), domains=DOMAINS, traits=TRAITS)
    return made.select("entity_id", "trait_id", F.round("confidence", 4).alias("confidence"), "evidence_count")


@query(f"""WITH {VERSIONS}, x AS (SELECT entity_id, version_number, trait_id FROM v UNION ALL SELECT v.entity_id, m.n + 1, trait_id FROM v JOIN (SELECT entity_id, max(version_number) AS n FROM v GROUP BY 1) m ON m.entity_id = v.entity_id AND m.n = version_number),
r AS (SELECT *, dense_rank() OVER (PARTITION BY entity_id ORDER BY version_number DESC) AS n FROM x) SELECT entity_id, version_number::INT AS version_number, trait_id FROM r WHERE n <= 3""")
def id_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-14, SNK-22."""
    v = versions_of(Tables(spark, sf_dir))
    last = v.groupBy("entity_id").agg(F.max("version_number").alias("version_number"))
    return I.next_version(v.join(last, ["entity_id", "version_number"]).select("entity_id", "trait_id", "confidence"), v, 3).select("entity_id", "version_number", "trait_id")


@query("SELECT c_custkey, round(greatest(0, least(1, least(c_nationkey / 10.0::DOUBLE, 1) * 0.4 + least(c_nationkey * 5 / 90.0::DOUBLE, 1) * 0.4 + 0.5 * 0.2 - least((c_nationkey % 4) * 0.2::DOUBLE, 0.6))), 4) AS raw FROM customer")
def id_stability_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-5, the model's formula."""
    n = F.col("c_nationkey")
    return Tables(spark, sf_dir).customer.select("c_custkey", I.stability_by_factors(n, n * 5, F.lit(0.5), n % 4).alias("raw"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN round(c * 0.7 + (0.5 * n + 0.9) / (n + 1) * 0.3, 4) ELSE greatest(0, c - 0.15) END AS confidence FROM (SELECT *, (c_nationkey / 25.0)::DOUBLE AS c, (c_nationkey + 1)::DOUBLE AS n FROM customer)")
def id_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-9."""
    n = F.col("c_nationkey")
    return Tables(spark, sf_dir).customer.select("c_custkey", I.resolved(n / 25.0, F.col("c_custkey") % 2 == 0, F.lit(0.5), n + 1).alias("confidence"))


@query("SELECT c_custkey, CASE WHEN c >= 0.8 THEN 'core' WHEN c >= 0.5 THEN 'medium' WHEN c >= 0.25 THEN 'low' ELSE 'unstable' END AS tier FROM (SELECT c_custkey, (c_nationkey / 25.0)::DOUBLE AS c FROM customer)")
def id_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-5, tiers."""
    return Tables(spark, sf_dir).customer.select("c_custkey", I.tier(T.clamp(F.col("c_nationkey") / 25.0)).alias("tier"))
