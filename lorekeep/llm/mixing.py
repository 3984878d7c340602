"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time 0..1.  Its integral gives
the source's cumulative token demand; inverting that demand at a document's
place in its source's token stream gives the document's training position;
documents are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, running, stored, unit

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix takes, and the most that a source repeats.
BUDGET, MOST = 1.5, 2
#: Schedules in source order, repeating: knots (time, relative weight), linear between.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)), ((0.0, 1.0), (1.0, 1.0)))

Schedule = Sequence[tuple[float, float]]


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, source_col: str, size_col: str, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """One row a source: ``source``, ``source_size``, ``ordinal``, ``target``.

    Targets share ``budget`` times all sizes by weight; none is above ``most``
    times its source's size, and the excess goes to the others by weight.
    This is water-filling: source s gets min(w*level, cap).  With sources
    sorted by cap/w, the capped ones are a prefix, so one running sum finds it.
    The windows below see one row a source, never documents.
    """
    by = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by = by.withColumn("ordinal", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    by = by.withColumn("w", pick).withColumn("cap", F.col("source_size") * F.lit(most))
    everyone = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("pot", F.sum("source_size").over(everyone).cast("double") * F.lit(float(budget)))
    by = by.withColumn("rest", F.col("pot") - F.coalesce(F.sum("cap").over(fill), F.lit(0)))
    by = by.withColumn("left_w", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(fill), F.lit(0)))
    # capped while the level that the remaining sources would get is above its own cap
    by = by.withColumn("full", F.col("rest") * F.col("w") > F.col("cap") * F.col("left_w"))
    open_rest = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everyone), F.lit(0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(everyone)
    share = F.col("w") * (F.col("pot") - open_rest) / open_w
    return by.select("source", "source_size", "ordinal", F.when(F.col("full"), F.col("cap")).otherwise(share).cast("double").alias("target"))


def inverse_demand(done: Column, schedule: Schedule) -> Column:
    """The time at which a source's demand has used the share ``done`` (0..1) of its total."""
    knots = list(schedule)
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, used = None, 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        slope, area = (w1 - w0) / (t1 - t0), (t1 - t0) * (w0 + w1) / 2
        r = done * F.lit(total) - F.lit(used)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * r, F.lit(0.0)))
        at = F.least(F.lit(t1), F.lit(t0) + 2 * r / (F.lit(w0) + root))
        used += area
        here = done * F.lit(total) < F.lit(used)
        out = F.when(here, at) if out is None else out.when(here, at)
        last = at
    return out.otherwise(last)


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget=BUDGET, most=MOST, schedules=SCHEDULES, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """One row a document: id, ``size``, ``source_size``, ``target``, ``taken``
    and ``positions`` (training time of each copy that the mix takes, at most
    ``most``), with the columns named in ``keep``.

    The token stream of a source is its documents in a seeded order, repeated.
    A copy is taken if the middle of its tokens is before the source's target,
    so the words taken differ from the target by half a document at most.
    No document is taken more than ``most`` times.

    Null texts have size 0; a null source is a source of its own, the last.
    Documents of size 0 are taken as the stream passes them.  Rows that repeat
    an id and size are interchangeable.  Texts count whole.  Empty table: no
    rows.  The hot source is never in one task (see ``base.running``); the
    table of sources is.
    """
    extra = [docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)]
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("src"), words(docs[text_col]).alias("size"), key.alias("key"), *extra)
    rows = rows.withColumn("draw", unit(F.col("key")))
    # words are counted once; texts, if kept, only pass by in the last step
    slim = stored(rows.drop(*[f"_keep{i}" for i in range(len(extra))]), "mix")
    targets = stored(source_targets(slim.select("src", "size"), "src", "size", weights, budget, most), "targets")
    rows = running(rows if extra else slim, ["src"], "draw", ["key", "size"], F.col("size"), "before", slim)
    rows = rows.join(targets, rows["src"].eqNullSafe(targets["source"])).drop("source")
    mid = F.col("before") + F.col("size") / 2.0
    copies = []
    for k in range(most):
        at = F.lit(k) * F.col("source_size") + mid
        done = F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(1.0))
        time = None
        for i, s in enumerate(schedules):
            t, here = inverse_demand(done, s), F.col("ordinal") % len(schedules) == i
            time = F.when(here, t) if time is None else time.when(here, t)
        copies.append(F.when(at < F.col("target"), time))
    positions = F.filter(F.array(*copies), lambda x: x.isNotNull())
    rows = rows.withColumn("positions", positions).withColumn("taken", F.col("size") * F.size("positions"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "positions", *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The training mix: a row of docs for every copy taken, range-sorted by
    training position.  Columns are those of docs, whatever their names."""
    cols, names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = {c: n for c, n in zip(cols, names, strict=True)}
    picked = curriculum(plain, at[id_col], at[text_col], at[source_col], keep=[n for n in names if n != at[id_col]], **params)
    tie = F.xxhash64(at[id_col])
    # a stored table between the two moves of the texts: the disk holds the files of one
    picked = stored(picked.filter(F.size("positions") > 0), "picked").select(*names, F.explode("positions").alias("position"))
    return picked.orderBy("position", tie).select(*[F.col(n).alias(c) for c, n in zip(cols, names, strict=True)])


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS ordinal
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][ordinal % 3 + 1] AS BIGINT) AS w, 2 * source_size AS cap FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS pot,
         coalesce(sum(cap) OVER (ORDER BY cap / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
  FROM w
), g AS (
  SELECT *, (pot - caps) * w > cap * left_w AS is_full FROM f
), t AS (
  SELECT source, source_size, ordinal,
         CAST(CASE WHEN is_full THEN cap
              ELSE w * (pot - coalesce(CAST(sum(cap) FILTER (WHERE is_full) OVER () AS DOUBLE), 0)) / sum(w) FILTER (WHERE NOT is_full) OVER () END AS DOUBLE) AS target
  FROM g
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.ordinal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(mid < target AS INT) + CAST(source_size + mid < target AS INT)) AS BIGINT) AS taken,
       round(CASE WHEN mid < target THEN CASE ordinal % 3
         WHEN 0 THEN least(1.0, 2 * (mid / target) / (1.5 + sqrt(greatest(0, 2.25 - 2 * (mid / target)))))
         WHEN 1 THEN CASE WHEN mid / target < 0.3125 THEN least(0.5, 2 * (mid / target) / (0.5 + sqrt(0.25 + mid / target)))
                          ELSE least(1.0, 0.5 + 2 * (mid / target - 0.3125) / (0.75 + sqrt(0.5625 + 5 * (mid / target - 0.3125)))) END
         ELSE mid / target END END, 9) AS position,
       round(CASE WHEN source_size + mid < target THEN CASE ordinal % 3
         WHEN 0 THEN least(1.0, 2 * ((source_size + mid) / target) / (1.5 + sqrt(greatest(0, 2.25 - 2 * ((source_size + mid) / target)))))
         WHEN 1 THEN CASE WHEN (source_size + mid) / target < 0.3125 THEN least(0.5, 2 * ((source_size + mid) / target) / (0.5 + sqrt(0.25 + (source_size + mid) / target)))
                          ELSE least(1.0, 0.5 + 2 * ((source_size + mid) / target - 0.3125) / (0.75 + sqrt(0.5625 + 5 * ((source_size + mid) / target - 0.3125)))) END
         ELSE (source_size + mid) / target END END, 9) AS second_position
FROM r
"""
