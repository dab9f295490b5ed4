"""Writing tables, joining chunk tables, and writing only once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.option("compression", "snappy").mode(mode).parquet(path)


def export_csv(
    df: DataFrame, path: str, files: int | None = None, compress: bool = True, mode: str = "errorifexists"
) -> None:
    """Quoted text with a header in each file. Written in parallel unless ``files`` says otherwise."""
    out = df.coalesce(files) if files else df
    out.write.mode(mode).options(
        header=True, quoteAll=True, escape='"', compression="gzip" if compress else "none"
    ).csv(path)


def concat_tables(tables: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """Union of chunk tables. Strict wants the same columns and types in the same order."""
    if not tables:
        raise ValueError("nothing to concatenate")

    def shape(df: DataFrame):
        return [(f.name, f.dataType) for f in df.schema]

    if strict:
        for i, table in enumerate(tables[1:], 1):
            if shape(table) != shape(tables[0]):
                raise ValueError(f"schema of table {i} differs: {table.schema.simpleString()}")
    return reduce(lambda a, b: a.unionByName(b), tables)


def write_once(df: DataFrame, path: str) -> None:
    """Write unless the target exists already."""
    df.write.option("compression", "snappy").mode("ignore").parquet(path)


def new_rows(batch: DataFrame, written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key has not been written. A null in a key equals a null."""
    theirs = written.select(*(F.col(key).alias(f"__key{i}") for i, key in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (F.col(key).eqNullSafe(F.col(f"__key{i}")) for i, key in enumerate(keys)))
    return batch.join(theirs, same, "left_anti")


def append_new(batch: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose key the target does not hold yet; a repeated batch adds nothing.

    A row with a null in its key cannot be told by the key, so its whole content is
    its key: rows with null keys are all written, each content once.
    """
    spark = batch.sparkSession
    partial = reduce(lambda a, b: a | b, (F.col(key).isNull() for key in keys))
    content = F.when(partial, F.sha2(F.to_json(F.struct(*batch.columns), {"ignoreNullFields": "false"}), 256))
    keyed = [*keys, "__content"]
    fresh = batch.withColumn("__content", content).dropDuplicates(keyed)
    if path_exists(spark, path):
        written = spark.read.schema(batch.schema).parquet(path).withColumn("__content", content)
        fresh = new_rows(fresh, written, keyed)
    fresh.drop("__content").write.mode("append").parquet(path)


def path_exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
