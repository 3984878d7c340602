"""A training corpus from ``documents``: five stages, each by one operator.

Each stage gets what its predecessor kept, written as Parquet and read again.
All but the last return the columns of documents, and further ones, whatever
their names, pass through.  Null ids are ids like any other, repeated rows are
copies, texts of any length are read whole, and an empty table gives no rows;
each stage says what it does with null and empty texts, and with ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm.base import stored
from lorekeep.llm.decontam import decontaminate
from lorekeep.llm.langid import fit, in_learned_language
from lorekeep.llm.mixing import mix
from lorekeep.llm.nearby import near_dedup
from lorekeep.llm.sharding import sharded


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language: null, empty, without letters, or not like a text of its size in one of
    them.  If no row is labelled, every text with letters stays."""
    return docs.filter(in_learned_language(fit(docs))(docs["text"]))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of least id, of each class of near copies; of
    rows that repeat id and text, one; of texts without words, one."""
    return near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item; null and empty texts contain none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often (0 to 2 times) as its source's target asks, in
    training order (ties by id); a null source is one of its own, a text without words weighs nothing."""
    return mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffles all rows into 24 shards; documents' columns, ``shard`` and ``slot``
    (``_shard`` and ``_slot`` where documents have such columns).  A null text is a row like any other."""
    return sharded(docs)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: The stages learn models and draw signatures, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
