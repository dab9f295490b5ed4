"""Joins and running values that hold up when one key owns much of the table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.session import materialize

# rows a block of one key should hold on average
BLOCK_ROWS = 1_000_000
# a block this many times as full calls for another way to cut
OVERFULL = 4
# ranges that cut clustered values; more only where blocks would exceed BLOCK_ROWS
MOST_RANGES = 400
# the block of rows without an order value
NULL_BLOCK = -(1 << 62)
# keys treated as hot: the most frequent ones, beyond this many rows
HOT_KEYS = 10_000
HOT_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the right side's keys are dropped."""
    theirs = {key: f"__key{i}" for i, key in enumerate(keys)}
    renamed = right.withColumnsRenamed(theirs)
    same = reduce(lambda a, b: a & b, (F.col(key).eqNullSafe(F.col(other)) for key, other in theirs.items()))
    return left.join(renamed, same, how).drop(*theirs.values())


def hot_join(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join one row of ``facts`` per key to many ``rows``; the facts of hot keys are repeated.

    A null key equals a null key. The most frequent keys, at most ``HOT_KEYS`` of them by construction, are
    broadcast as hash and number of parts. Rows of such a key are dealt over its
    parts and its facts repeated once per part; all other keys join as they are.
    Keys that share a hash share their parts, which changes nothing in the result.
    """
    hashed = rows.withColumn("__h", F.xxhash64(*keys))
    counted = hashed.groupBy("__h").agg(F.count("*").alias("__n"))
    hot = (
        counted.filter(F.col("__n") > hot_rows)
        .orderBy(F.desc("__n"))
        .limit(HOT_KEYS)
        .select("__h", F.ceil(F.col("__n") / hot_rows).cast("int").alias("__parts"))
    )
    part = F.pmod(F.xxhash64(*spread_by), F.coalesce("__parts", F.lit(1))).cast("int")
    dealt = hashed.join(F.broadcast(hot), "__h", "left").withColumn("__part", part)
    last = F.coalesce("__parts", F.lit(1)) - 1
    repeated = (
        facts.withColumn("__h", F.xxhash64(*keys))
        .join(F.broadcast(hot), "__h", "left")
        .withColumn("__part", F.explode(F.sequence(F.lit(0), last)))
        .drop("__parts", "__h")
    )
    joined = null_safe_join(dealt, repeated, [*keys, "__part"], how)
    return joined.drop("__h", "__parts", "__part")


def order_number(column: Column, data_type: str) -> Column:
    """An order column as a whole number; times count in microseconds."""
    if data_type == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    if data_type in ("timestamp", "timestamp_ltz"):
        return F.unix_micros(column)
    if data_type == "date":
        return F.unix_date(column).cast("long")
    return column.cast("long")


def with_block(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_block: int = BLOCK_ROWS,
    width: int | None = None,
) -> DataFrame:
    """Add ``__block``: blocks of one key follow each other in its order and stay small.

    A block is a slice of the first order column's range, so it depends on the
    row's own value only and is the same however often the plan runs. Without
    ``width`` one pass over that column (minimum, maximum, count) picks the
    slices, and a second one checks that no (key, block) is overfull. If values
    cluster too much for that, blocks come from a range partitioning over keys and
    all order columns, fixed by a checkpoint. A range is a task and the driver holds
    its bounds, so there are ``MOST_RANGES``, or as many as ``BLOCK_ROWS`` asks for.
    """
    number = order_number(F.col(order[0]), df.schema[order[0]].dataType.simpleString())

    def cut(width: int) -> DataFrame:
        # nulls come first in an order, so their block does as well
        return df.withColumn("__block", F.coalesce(F.floor(number / F.lit(width)).cast("long"), F.lit(NULL_BLOCK)))

    if width is not None:
        return cut(width)
    low, high, n = df.agg(F.min(number), F.max(number), F.count("*")).first()
    if n <= rows_per_block:
        return df.withColumn("__block", F.lit(0).cast("long"))
    width = max(1, (high - low + 1) * rows_per_block // n) if low is not None else 1
    blocked = cut(width)
    fullest = blocked.groupBy(*keys, "__block").count().agg(F.max("count")).first()[0]
    if fullest <= OVERFULL * rows_per_block:
        return blocked
    parts = min(n // rows_per_block, max(n // BLOCK_ROWS, MOST_RANGES)) + 1
    ranged = df.repartitionByRange(int(parts), *keys, *order)
    return materialize(ranged.withColumn("__block", F.spark_partition_id().cast("long")))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    rows_per_block: int = BLOCK_ROWS,
    width: int | None = None,
) -> DataFrame:
    """Sums over the rows of a key up to and including the current one.

    Two levels: totals per (key, block), their running sum per key, and a window
    inside each (key, block). No task sees more of a hot key than one block or
    its list of block totals. ``order`` must be unique per key; its first column
    defines the blocks. A null key is a key like others; a null order value comes first.
    """
    keys = list(keys)
    blocked = with_block(df, keys, order, rows_per_block, width)
    totals = blocked.groupBy(*keys, "__block").agg(
        *(F.sum(expr).alias(f"__total_{name}") for name, expr in sums.items())
    )
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys,
        "__block",
        *(
            F.coalesce(F.sum(f"__total_{name}").over(before), F.lit(0)).alias(f"__before_{name}")
            for name in sums
        ),
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = blocked.withColumns(
        {f"__local_{name}": F.sum(expr).over(inside) for name, expr in sums.items()}
    )
    joined = null_safe_join(local, offsets, [*keys, "__block"])
    return joined.select(
        *df.columns,
        *((F.col(f"__local_{n}") + F.col(f"__before_{n}")).alias(n) for n in sums),
    )


def running_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "row_no",
    rows_per_block: int = BLOCK_ROWS,
    width: int | None = None,
) -> DataFrame:
    """Number the rows of each key from 1, in order."""
    return running_sum(df, keys, order, {name: F.lit(1)}, rows_per_block, width)


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    rows_per_block: int = BLOCK_ROWS,
    width: int | None = None,
) -> DataFrame:
    """The value one row earlier in the key's order, across block borders."""
    keys = list(keys)
    blocked = with_block(df, keys, order, rows_per_block, width)
    lasts = blocked.groupBy(*keys, "__block").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last")
    )
    carried = lasts.select(
        *keys,
        "__block",
        F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block")).alias("__carried"),
    )
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    local = blocked.withColumn(
        "__prev", F.lag(F.struct(F.col(value).alias("v"))).over(inside)
    )
    joined = null_safe_join(local, carried, [*keys, "__block"])
    return joined.select(
        *df.columns, F.coalesce(F.col("__prev"), F.col("__carried"))["v"].alias(name)
    )
