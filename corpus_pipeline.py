"""The corpus pipeline: each stage works on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, minhash, mixing, quality
from tessera.llm.common import settled, stage  # noqa: F401  (stage writes results where stages are run one by one)
from tessera.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_level_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_rules),
    ("lines", line_level_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result but the last staged in the shared folder; what a stage staged on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, apply in first:
        docs = settled(spark, lambda apply=apply, docs=docs: apply(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)


#: Weak supervision and MinHash aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
