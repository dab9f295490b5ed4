"""The corpus pipeline: from raw documents to sharded training data.

Each stage takes what the one before kept, written as Parquet and read again. In every
stage null texts count as empty ones, repeated rows are rows of their own (but for
near-duplicates, where one stays), an empty table stays empty, and further columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiframe.llm import decontaminate, mixing, neardup, quality, sharding
from lexiframe.session import apply_settings, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    return quality.accepted(docs, _table(apply_settings(spark), sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    apply_settings(spark)
    return neardup.deduplicated(docs)


def decontaminate_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold too much of the benchmark."""
    return decontaminate.decontaminated(docs, _table(apply_settings(spark), sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks for."""
    apply_settings(spark)
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its shard, by way of virtual slots."""
    return sharding.with_shards(docs, scratch_path(apply_settings(spark), "slot-map"))


STAGES = [
    ("quality", accept),
    ("neardup", deduplicate),
    ("decontaminate", decontaminate_tests),
    ("mix", mix),
    ("shard", shard),
]

#: A trained network decides the first stage, which SQL cannot say; tests compare all stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
