"""Helpers shared by the corpus operators."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.session import scratch_path

#: Characters that separate words in the mixing and language-model contracts.
SPACE = r"\x20\x09-\x0D"


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only.

    Texts without other characters than ASCII take the fast general function,
    which does the same there.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def stored(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    Later steps read the files: lineage is short, nothing is computed twice, and
    a lost executor costs only the tasks that were running on it. Readers hold a
    whole row group where its rows are few and large; ``group_rows`` bounds them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hex_number(digest: Column, first: int, digits: int) -> Column:
    """``digits`` hexadecimal characters of a digest, from ``first`` (1-based), as a long."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")
