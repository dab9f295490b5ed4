"""Results of texts, kept between runs.

A store is a folder of bucketed files: results by the digest of their text. A run looks
its texts up there, computes only those that are new, and adds them. The store is read
in its buckets, so it is never shuffled, however large it has grown; only the run's own
rows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.operators.skew import HOT_ROWS, hot_join
from lexiframe.session import scratch_path

KEY = "text_key"
BUCKETS = 64


def text_key(text: Column) -> Column:
    """The digest a text is kept under; null texts have none."""
    return F.sha2(text, 256)


class TextStore:
    """The results in a folder that all executors share.

    ``schema`` names the result columns. A folder belongs to one function, one schema and one number
    of buckets; another run opens it with the same. One run adds at a time: an append shows whole or
    not at all, but two runs at once could both add a text.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/buckets-{buckets}"
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self.name = f"text_store_{hashlib.md5(self.path.encode()).hexdigest()}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (`{KEY}` STRING, {columns}) USING parquet "
            f"CLUSTERED BY (`{KEY}`) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        """All kept results with their keys."""
        return self.spark.table(self.name)

    def unknown(self, df: DataFrame, text: str) -> DataFrame:
        """(key, text): the texts of a table, each once, that have no result here."""
        keyed = df.select(text_key(F.col(text)).alias(KEY), F.col(text)).filter(f"`{KEY}` IS NOT NULL")
        # one text a key, combined before the shuffle; then the store is met in its own buckets
        distinct = keyed.groupBy(KEY).agg(F.first(text).alias(text))
        return distinct.join(self.table().select(KEY), KEY, "left_anti")

    def add(self, results: DataFrame) -> None:
        """Append results (key and the columns of the schema)."""
        columns = [KEY, *(f.name for f in self.schema.fields)]
        rows = results.select(columns).repartition(self.buckets, KEY)
        rows.write.bucketBy(self.buckets, KEY).mode("append").format("parquet").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def apply(
        self, df: DataFrame, text: str, row_id: str, fn: Callable[[DataFrame], DataFrame], hot_rows: int = HOT_ROWS
    ) -> DataFrame:
        """Every row of ``df`` with its text's result; ``fn`` runs on new texts only.

        ``fn`` takes a table with the column ``text`` and returns it with the columns of the schema. Rows with a
        null text get nulls. Rows of a very frequent text are joined in several parts.
        """
        path = scratch_path(self.spark, "new-texts")
        self.unknown(df, text).write.parquet(path)
        new = self.spark.read.parquet(path)
        if not new.isEmpty():
            results = fn(new.select(text)).withColumn(KEY, text_key(F.col(text)))
            self.add(results)
        keyed = df.withColumn(KEY, text_key(F.col(text)))
        # the results this run needs, met in the store's buckets; then back to the rows, hot ones split
        wanted = keyed.select(KEY).filter(f"`{KEY}` IS NOT NULL").distinct()
        return hot_join(keyed, wanted.join(self.table(), KEY), [KEY], [row_id], hot_rows=hot_rows).drop(KEY)
