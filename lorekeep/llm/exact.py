"""Exact dedup: 128-bit content hash, smallest id stays, bytes compared in groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACES, fresh, joined_back, stored


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def md5_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=md5_hash) -> DataFrame:
    """Every row of docs with its group of equal texts.

    Returns the id (under its name), ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``, one row for each input row.

    * The slim table (id, hash, digest, row number) is stored once; groups
      are formed over it with a partial aggregate, so a text that a third of
      all rows share collapses before it moves.
    * Rows get their group's columns by a join that broadcasts the few hot
      groups (see ``base.joined_back``).
    * Bytes are compared by a second aggregate that groups by hash *and*
      text: a hash that two texts share shows up there as two rows.  Only if
      there is such a hash, the whole assignment is made by the text itself.
    * Null texts equal empty ones.  Null ids sort after all others.  Of rows
      that repeat id and text, one is kept.  An empty table gives no rows.
      Other columns are ignored, whatever their names.  Ids of any type.
    """
    rows = docs.select(docs[id_col].alias("id"), normalised(docs[text_col]).alias("norm"))
    rows = rows.withColumn("h", content_hash(F.col("norm")))
    texts = rows.groupBy("h", "norm").agg(F.lit(1).alias("one"))
    clash = texts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slim = rows.select("id", "h", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    if clash.limit(1).count():
        # a collision: the text takes the place of its hash
        slim = rows.select("id", F.col("norm").alias("h"), F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row"))
    slim = stored(slim, "exact")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))
    groups = slim.groupBy("h").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.select(F.col("h").alias("g"), "first", "group_size"), "groups")
    return joined_back(slim, groups, "h", "g", "group_size", slim.count()).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay.

    As ``exact_groups`` decides it; of rows that repeat an id and a text, one
    stays.  The joined-back key is (id, digest), so texts of equal ids do not mix.
    """
    key, n = fresh(docs.columns, "_sha"), fresh(docs.columns, "_copy")
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    rows = docs.withColumn(key, F.sha2(normalised(docs[text_col]), 256))
    rows = rows.join(kept, rows[id_col].eqNullSafe(kept["_kept_id"]) & (rows[key] == kept["_kept_sha"]), "left_semi")
    one = Window.partitionBy(id_col, key).orderBy(F.xxhash64(*docs.columns))
    return rows.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).drop(n, key)


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
