"""Numbering rows into chunks and chunks into batches, and keys made from content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.operators.skew import running_index

# Rows per chunk and chunks per batch.
CHUNK_ROWS = 500
BATCH_CHUNKS = 5


def assign_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    size: int = CHUNK_ROWS,
    job: str | None = None,
    **blocks,
) -> DataFrame:
    """Add ``chunk_no`` (from 1) and ``chunk_id``: consecutive blocks of ``size`` rows."""
    numbered = running_index(df, keys, order, "__row_no", **blocks)
    number = F.floor((F.col("__row_no") - 1) / size).cast("int") + 1
    label = F.col(job) if job else F.lit("job")
    return numbered.withColumn("chunk_no", number).withColumn(
        "chunk_id", F.concat(label.cast("string"), F.lit("_chunk_"), number.cast("string"), F.lit("_csv"))
    ).drop("__row_no")


def assign_batches(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = BATCH_CHUNKS, **blocks
) -> DataFrame:
    """Add ``batch_no`` (from 0): consecutive lists of ``size`` rows per key."""
    numbered = running_index(df, keys, order, "__row_no", **blocks)
    return numbered.withColumn(
        "batch_no", F.floor((F.col("__row_no") - 1) / size).cast("int")
    ).drop("__row_no")


def content_key(c: Column) -> Column:
    return F.md5(c.cast("string"))


def batch_key(keys: Column) -> Column:
    """One key for a set of keys, whatever their order. ``keys`` is an array."""
    return F.md5(F.array_join(F.sort_array(keys), ""))


def final_key(job: Column, keys: Column) -> Column:
    return F.md5(F.concat(job.cast("string"), F.lit("_"), F.array_join(F.sort_array(keys), "|")))
