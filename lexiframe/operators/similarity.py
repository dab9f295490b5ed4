"""Nearest neighbours among the vectors of a whole table, by cosine.

Vectors are dealt to lists by their nearest centroid. A query meets the vectors of its
nearest lists first. That alone is the approximate search. For the exact one, the
distance of its k-th neighbour so far rules out every list that lies too far away for
its radius, and the query meets the rest. Lists and the queries of a list are cut into
blocks of bounded size, so a crowded list is many tasks, and no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.session import scratch_path

#: Vectors that centroids are fitted on, at most, and rounds of fitting.
SAMPLE_ROWS, ROUNDS = 50_000, 10
#: Most lists; there are about as many as the root of the number of vectors.
MOST_LISTS = 4096
#: Lists that a query meets first.
PROBES = 8
#: Vectors of a block, queries of a block, queries that are multiplied together.
BLOCK_ROWS, BLOCK_QUERIES, CHUNK = 20_000, 50_000, 256
#: Digits to which cosines are equal.
DIGITS = 9
#: What rounding may add to an angle.
SLACK = 1e-6


@dataclass
class Lists:
    """Unit centroids, and for each list the largest angle between its centroid and a vector in it."""

    centroids: np.ndarray
    radius: np.ndarray | None = None


def units(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of equal length as rows of length one."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def fit(vectors: DataFrame, lists: int, id_col: str = "id", vector_col: str = "vector") -> Lists:
    """Centroids of at most SAMPLE_ROWS vectors, those whose ids hash smallest: each moves to the mean of those nearest to it."""
    few = vectors.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).select(vector_col).toArrow()
    rows = units(few.column(0).combine_chunks())
    if not len(rows):
        return Lists(np.zeros((0, 1)))
    centroids = rows[:: max(1, len(rows) // lists)][:lists].copy()
    for _ in range(ROUNDS):
        home = np.concatenate([(rows[k : k + 8192] @ centroids.T).argmax(1) for k in range(0, len(rows), 8192)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return Lists(centroids)


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows with an id and a vector that points somewhere."""
    vector = F.col("vector")
    rows = table.select(table[id_col].alias("id"), table[vector_col].cast("array<double>").alias("vector"))
    known = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    return rows.filter(F.col("id").isNotNull() & (known > 0))


def _indexed(vectors: DataFrame, lists: Lists) -> DataFrame:
    """Add each vector's list and its angle to the centroid."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    shared = vectors.sparkSession.sparkContext.broadcast(lists)  # at most MOST_LISTS centroids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosines = units(batch.column(1)) @ shared.value.centroids.T
                home = cosines.argmax(1)
                angle = np.arccos(np.clip(cosines[np.arange(len(home)), home], -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(angle)], schema.names)

    return vectors.mapInArrow(run, schema)


def _probes(queries: DataFrame, lists: Lists, probes: int, rest: bool) -> DataFrame:
    """(id, vector, list): the ``probes`` nearest lists of each query; or the ``rest`` that its ``reach`` (an angle) leaves possible."""
    schema = T.StructType([*queries.schema.fields[:2], T.StructField("list", T.IntegerType())])
    shared = queries.sparkSession.sparkContext.broadcast(lists)  # at most MOST_LISTS centroids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(shared.value.centroids):
                continue
            away = angles(units(batch.column(1)), shared.value.centroids)
            near = np.zeros(away.shape, bool)
            nearest = np.argsort(away, axis=1, kind="stable")[:, :probes]
            np.put_along_axis(near, nearest, True, 1)
            if rest:
                reach = batch.column(2).to_numpy(zero_copy_only=False)
                near = ~near & (away - shared.value.radius <= reach[:, None] + SLACK)
            query, chosen = np.nonzero(near)
            taken = pa.array(query)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(chosen.astype(np.int32))], schema.names
            )

    return queries.mapInArrow(run, schema)


def _met(indexed: DataFrame, probes: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(query, id, cosine): for each query the ``k`` best vectors of every block that it meets."""
    asked = probes.groupBy("list").agg(F.count("*").alias("queries"))
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    blocks = sizes.join(asked, "list").select(
        "list", cut("rows", BLOCK_ROWS).alias("blocks"), cut("queries", BLOCK_QUERIES).alias("query_blocks")
    )
    blocks = F.broadcast(blocks)  # at most MOST_LISTS rows
    place = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = probes.join(blocks, "list").select("id", "vector", "list", each("blocks").alias("block"), place("query_blocks").alias("query_block"))
    right = indexed.join(blocks, "list").select("id", "vector", "list", place("blocks").alias("block"), each("query_blocks").alias("query_block"))
    kind = indexed.schema["id"].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("id", kind), T.StructField("cosine", T.DoubleType())])
    keys = ["list", "block", "query_block"]

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if ours.num_rows and theirs.num_rows:
            theirs = theirs.sort_by("id")
            mine, others = (units(t.column("vector").combine_chunks()) for t in (ours, theirs))
            for at in range(0, len(mine), CHUNK):
                cosines = np.round(mine[at : at + CHUNK] @ others.T, DIGITS)
                n = min(k, len(others))
                # of equal cosines the smaller id, so a plain partition does not do at the border
                border = -np.partition(-cosines, n - 1, axis=1)[:, n - 1 : n]
                row, column = np.nonzero(cosines >= border)
                value = cosines[row, column]
                order = np.lexsort((column, -value, row))
                row, column, value = row[order], column[order], value[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                best = rank < n
                out.append(
                    pa.table(
                        [
                            ours.column("id").take(pa.array(row[best] + at)),
                            theirs.column("id").take(pa.array(column[best])),
                            pa.array(value[best]),
                        ],
                        names=schema.names,
                    )
                )
        empty = pa.table([pa.array([], ours.schema.field("id").type)] * 2 + [pa.array([], pa.float64())], names=schema.names)
        return pa.concat_tables(out) if out else empty

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "id",
    vector_col: str = "vector",
    exact: bool = True,
    lists: int | None = None,
    probes: int = PROBES,
) -> DataFrame:
    """(query, rank, id, cosine): the ``k`` vectors of the table nearest to each query, itself among them.

    Equal cosines (to nine digits) are ordered by id. Both tables need ids of one type, unique in
    ``queries``; rows without id, null vectors and zero vectors are left out. All vectors have the
    same number of parts. Without ``exact`` only the ``probes`` nearest lists are searched. Empty
    tables give an empty result.
    """
    spark = vectors.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col)
    number = rows.count()
    found = fit(rows, lists or int(min(MOST_LISTS, max(1, number**0.5))))
    indexed = stored(_indexed(rows, found), "vector-lists")
    facts = indexed.groupBy("list").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    facts = stored(facts, "list-facts")
    found.radius = np.zeros(len(found.centroids))
    for r in facts.collect():  # at most MOST_LISTS rows
        found.radius[r.list] = r.radius
    sizes = facts.select("list", "rows")
    first = stored(_best(_met(indexed, _probes(asked, found, probes, False), sizes, k), k), "near-first")
    if exact:
        reach = first.filter(F.col("rank") == k).select(F.col("query").alias("id"), F.acos(F.least("cosine", F.lit(1.0))).alias("reach"))
        farther = asked.join(reach, "id", "left").select("id", "vector", F.coalesce("reach", F.lit(np.pi)).alias("reach"))
        more = _met(indexed, stored(_probes(farther, found, probes, True), "near-rest"), sizes, k)
        first = _best(first.drop("rank").unionByName(more), k)
    return first.select("query", "rank", "id", "cosine")
