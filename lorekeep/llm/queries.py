"""The registered queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import unit
from .exact import EXACT_SQL, exact_groups
from .decontam import contamination
from .html import extract
from .langid import identify
from .mixing import MIXING_SQL, curriculum
from .nearby import near_groups
from .oracle import NEAR_SQL, SECRETS_SQL, SUBSTRING_SQL
from .phrases import PHRASES_SQL, collocations
from .secrets import scan_secrets
from .sharding import shard_rows
from .substring import repeated_words
from .suffix import repeated_passages
from .toxicity import toxicity
from .whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(_table(spark, sf_dir, "documents"))
    at = [F.round(F.get("positions", F.lit(i)), 9).alias(n) for i, n in enumerate(("position", "second_position"))]
    mixed = mixed.select("doc_id", "size", "source_size", "target", "taken", *at)
    # range-sorted by the first training position; documents not taken follow
    return mixed.orderBy(F.coalesce("position", 1 + unit(F.md5(F.col("doc_id").cast("string")))))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(_table(spark, sf_dir, "documents"), keep_text=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents")).drop("text_key")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("earlier_id", "earlier_doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def whitened_components(rows: DataFrame) -> DataFrame:
    """A row for each vector and component."""
    each = whiten(rows).select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "own"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "own.whitened", "own.explained", "identity_error", "deviation_text")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(_table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_decontamination, op2_mixing, op3_substring_dedup, op4_exact_dedup, op5_near_dedup,
    op6_language_id, op7_suffix_dedup, op8_sharding, op9_secrets, op10_html_extraction,
    op11_toxicity, op12_phrases, op13_whitening,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {"op2_mixing": MIXING_SQL, "op3_substring_dedup": SUBSTRING_SQL, "op4_exact_dedup": EXACT_SQL, "op5_near_dedup": NEAR_SQL, "op9_secrets": SECRETS_SQL, "op12_phrases": PHRASES_SQL}
