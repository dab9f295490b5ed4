"""The request limiter as a table operator.

A counter that starts afresh at some request decides alone when the next fresh start
is: after the limit-th accepted request, or the last one before a pause, plus one
period. So fresh starts are pointers that do not depend on what came before. A
client's requests are cut into blocks of time; a block's pointers need its own and
the next block's requests. Which pointers are really followed is found by doubling:
paths over 1, 2, 4 and so on blocks. A client without any pause is thus many small
groups and a logarithm of rounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.operators.skew import null_safe_join, order_number
from lexiframe.session import materialize

# Accepted requests per period, and the period in seconds.
LIMIT, TTL_SECONDS = 10, 60
# a block spans this many times the longest reach of a pointer
REACHES = 4


def pointers(at: np.ndarray, own: int, limit: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """For a fresh start at each of the first ``own`` requests: its last accepted request, the next fresh start.

    ``at`` holds the times of a block and the next one, in order.
    """
    index = np.arange(own)
    pauses = np.append(np.flatnonzero(np.diff(at) >= ttl), len(at) - 1)
    last = np.minimum(index + limit - 1, pauses[np.searchsorted(pauses, index)])
    return last, np.searchsorted(at, at[last] + ttl, "left")


def _leaving(at: np.ndarray, own: int, limit: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """For a fresh start at each own request: the first fresh start in the next block, and
    how many of the next block's requests are accepted before it."""
    last, after = pointers(at, own, limit, ttl)
    here, to = np.arange(own), after.copy()
    while (inside := np.flatnonzero(to < own)).size:
        here[inside] = to[inside]
        to[inside] = after[here[inside]]
    return to - own, np.maximum(last[here] + 1 - own, 0)


def _blocks(slim: DataFrame, client: str, id_col: str, limit: int, ttl: int) -> DataFrame:
    """One row per client and block: own and next block's requests, and whether a pause comes before it."""
    width = REACHES * (limit + 1) * ttl
    placed = slim.withColumn("__block", F.floor(F.col("__at") / F.lit(width)))
    # a request stands in its own block and ahead of the one before
    both = placed.withColumn("__b", F.explode(F.array(F.col("__block"), F.col("__block") - 1)))
    mine = F.col("__b") == F.col("__block")
    rows = F.sort_array(F.collect_list(F.struct(F.col("__at").alias("at"), F.col(id_col).alias("id"))))
    groups = both.groupBy(client, F.col("__b").alias("block")).agg(
        rows.alias("reqs"), F.count(F.when(mine, 1)).cast("int").alias("own"), F.max(F.when(mine, F.col("__at"))).alias("latest")
    )
    groups = materialize(groups.filter("own > 0"))
    before = F.lag("latest").over(Window.partitionBy(client).orderBy("block"))
    ends = groups.select(client, "block", before.alias("before"))
    fresh = F.col("before").isNull() | (F.get("reqs", F.lit(0))["at"] - F.col("before") >= ttl)
    joined = null_safe_join(groups, ends, [client, "block"])
    return joined.select(client, "block", "own", "reqs", fresh.alias("fresh"))


def _ways(blocks: DataFrame, client: str, limit: int, ttl: int) -> DataFrame:
    """(client, block, entry, exit, carried): per block and fresh start where its path leaves the block.

    Only for starts that a path from the block before can reach.
    """
    kind = blocks.schema[client]
    schema = T.StructType(
        [kind, T.StructField("block", T.LongType()), T.StructField("exits", T.ArrayType(T.IntegerType())),
         T.StructField("carried", T.ArrayType(T.IntegerType()))]
    )

    def leave(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [
                _leaving(at.values.to_numpy(), own, limit, ttl)
                for at, own in zip(batch.column(2), batch.column(3).to_pylist())
            ]
            lists = [pa.array([x[k].astype(np.int32) for x in left], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], schema.names)

    slim = blocks.select(client, "block", F.col("reqs.at").alias("at"), "own")
    exits = materialize(slim.mapInArrow(leave, schema))
    reached = exits.select(client, (F.col("block") + 1).alias("block"), F.explode(F.array_distinct("exits")).alias("entry"))
    roots = blocks.filter("fresh").select(client, "block", F.lit(0).alias("entry"))
    starts = reached.unionByName(roots).distinct()
    ways = null_safe_join(starts, exits, [client, "block"]).filter(F.col("entry") < F.size("exits"))
    return materialize(
        ways.select(
            client, "block", "entry", F.get("exits", F.col("entry")).alias("exit"), F.get("carried", F.col("entry")).alias("carried")
        )
    )


def _entries(blocks: DataFrame, ways: DataFrame, client: str) -> DataFrame:
    """(client, block, entry, carried): the fresh start with which each block really begins."""
    zero = F.lit(0)
    found = blocks.filter("fresh").select(client, "block", zero.alias("entry"), zero.alias("carried"))
    jump, step = ways, 1
    while not jump.isEmpty():
        key = [client, "block", "entry"]
        onward = null_safe_join(found.drop("carried"), jump, key).select(
            client, (F.col("block") + step).alias("block"), F.col("exit").alias("entry"), "carried"
        )
        found = materialize(found.unionByName(onward).distinct())
        far = jump.select(client, F.col("block").alias("from"), F.col("entry").alias("start"), (F.col("block") + step).alias("block"), F.col("exit").alias("entry"))
        jump = materialize(
            null_safe_join(far, jump, key).select(
                client, F.col("from").alias("block"), F.col("start").alias("entry"), "exit", "carried"
            )
        )
        step *= 2
    return found


def rate_limit(
    requests: DataFrame,
    client: str = "client",
    ts: str = "ts",
    id_col: str = "id",
    limit: int = LIMIT,
    ttl_seconds: int = TTL_SECONDS,
) -> DataFrame:
    """``(client, id, accepted)`` for every request, in the order of ``ts`` and ``id``.

    A group is a client's requests of ``2 * REACHES * (limit + 1)`` periods. Requests without a
    client are one client's; requests without a time are neither accepted nor refused.
    """
    at = order_number(F.col(ts), requests.schema[ts].dataType.simpleString())
    ttl = ttl_seconds * 1_000_000
    slim = requests.select(client, id_col, at.alias("__at"))
    blocks = materialize(_blocks(slim.filter("__at IS NOT NULL"), client, id_col, limit, ttl))
    entries = _entries(blocks, _ways(blocks, client, limit, ttl), client)
    started = null_safe_join(blocks, entries, [client, "block"])
    schema = T.StructType(
        [requests.schema[client], requests.schema[id_col], T.StructField("accepted", T.BooleanType())]
    )

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owned = batch.column(3).to_pylist()
            flags = [
                _accepted(times.values.to_numpy(), own, entry, carried, limit, ttl)
                for times, own, entry, carried in zip(batch.column(1), owned, batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ]
            if flags:
                ids = pa.concat_arrays([x.values.slice(0, own) for x, own in zip(batch.column(2), owned)])
                clients = batch.column(0).take(pa.array(np.repeat(np.arange(len(owned)), owned)))
                yield pa.RecordBatch.from_arrays([clients, ids, pa.array(np.concatenate(flags))], schema.names)

    rows = started.select(client, F.col("reqs.at").alias("at"), F.col("reqs.id").alias("ids"), "own", "entry", "carried")
    decided = rows.mapInArrow(decide, schema)
    timeless = slim.filter("__at IS NULL").select(client, id_col, F.lit(None).cast("boolean").alias("accepted"))
    return decided.unionByName(timeless)


def _accepted(at: np.ndarray, own: int, entry: int, carried: int, limit: int, ttl: int) -> np.ndarray:
    flags = np.zeros(own, bool)
    flags[:carried] = True
    last, after = pointers(at, own, limit, ttl)
    while entry < own:
        flags[entry : last[entry] + 1] = True
        entry = int(after[entry])
    return flags
