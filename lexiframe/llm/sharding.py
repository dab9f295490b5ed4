"""Sharding by fixed virtual slots.

Every record hashes to one of thousands of slots and never changes slot. What a
slot weighs is summed once, and a small versioned table says which shard owns
which slot. Rebalancing edits that table; records move only with their slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.common import stored

SLOTS = 4096
SHARDS = 24
#: Bytes counted for a record beside its text.
RECORD_BYTES = 8


def record_slots(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) per record.

    Id and text decide the slot, so records without an id spread as well. Only
    records equal in both share a slot by design.
    """
    size, crc, slot = _slot(docs[id_col], docs[text_col], slots)
    return docs.select(
        docs[id_col].alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), slot.alias("virtual_slot")
    )


def _slot(id_col: Column, text_col: Column, slots: int) -> tuple[Column, Column, Column]:
    text = F.coalesce(text_col, F.lit(""))
    size = (F.octet_length(text) + RECORD_BYTES).cast("long")
    crc = F.crc32(text.cast("binary"))
    return size, crc, F.pmod(F.xxhash64(id_col, crc, size), F.lit(slots)).cast("int")


def slot_weights(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, records) for every slot, empty ones included: ``slots`` rows."""
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["bytes", "records"])


def _deal(weights: DataFrame, loads: DataFrame | None, shards: int) -> DataFrame:
    """Give slots to shards, heaviest slot first, each to the shard with the least bytes so far.

    A fold over one array of at most ``slots`` entries, whatever the corpus size.
    """
    listed = weights.agg(
        F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot")), asc=False).alias("slots")
    )
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    if loads is None:
        one = listed.withColumn("loads", none)
    else:
        kept = loads.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes"))).alias("kept"))
        one = listed.join(kept).withColumn(  # one row on either side
            "loads",
            F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.col("kept")[s], F.lit(0).cast("long"))),
        )

    def give(state, slot):
        least = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        return F.struct(
            F.transform(state["loads"], lambda b, i: b + F.when(i == least, slot["bytes"]).otherwise(0)).alias("loads"),
            F.concat(state["owners"], F.array(least.cast("int"))).alias("owners"),
        )

    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("owners"))
    dealt = one.select("slots", F.aggregate("slots", start, give)["owners"].alias("owners"))
    pairs = dealt.select(F.explode(F.arrays_zip("slots", "owners")).alias("x"))
    return pairs.select(F.col("x.slots.virtual_slot").alias("virtual_slot"), F.col("x.owners").alias("shard"))


def first_map(weights: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: (version, virtual_slot, shard) for every slot."""
    return _deal(weights, None, shards).select(F.lit(1).alias("version"), "virtual_slot", "shard")


def edited_map(current: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for new weights or another number of shards.

    Each shard that remains keeps its heaviest slots up to an equal share of the
    bytes; slots beyond that, and those of shards that go, are dealt to the shards
    with the least. All other slots stay where they are.
    """
    total = weights.agg(F.sum("bytes").alias("total"))
    held = current.join(weights, "virtual_slot").join(total)
    inside = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("sum", F.sum("bytes").over(inside)).withColumn(
        "stays", (F.col("shard") < shards) & (F.col("sum") * shards <= F.col("total"))
    )
    stays = held.filter("stays")
    loads = stays.groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    moved = _deal(held.filter("NOT stays").select("virtual_slot", "bytes"), loads, shards)
    version = current.agg((F.max("version") + 1).alias("version"))
    return stays.select("virtual_slot", "shard").unionByName(moved).join(version).select("version", "virtual_slot", "shard")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to a stored map. Writing a version again replaces that version alone."""
    slot_map.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, the newest by default."""
    table = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is not None:
        return table.filter(F.col("version") == version)
    return table.join(table.agg(F.max("version").alias("version")), "version")


def positions(records: DataFrame, slot_map: DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard: 0, 1, 2 and so on without gaps.

    A slot's first place comes from the counts of the slots before it, a record's
    place inside from its slot alone, so no task sorts a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    owners = slot_map.join(weights, "virtual_slot").select(
        "virtual_slot", "shard", "version", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("place", F.row_number().over(inside))
    # one row per slot: bounded by the number of slots
    return placed.join(F.broadcast(owners), "virtual_slot").withColumn(
        "slot", (F.col("first") + F.col("place") - 1).cast("long")
    )


def shard_documents(
    docs: DataFrame,
    map_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
) -> DataFrame:
    """One row per record with its shard, by law ``bytes``: shard sizes near equal.

    A null text has no bytes, a null id is an id like others. Equal records are
    numbered in any order. Only the two named columns are read. An empty table
    gives an empty result and a map of empty slots. One record never splits, so a
    record larger than a shard's share makes that shard the largest.

    Version 1 of the map is stored under ``map_path``.
    """
    records = stored(record_slots(docs, id_col, text_col, slots), "records")
    weights = stored(slot_weights(records, slots), "slot-weights")
    save_map(first_map(weights, shards), map_path)
    placed = positions(records, load_map(docs.sparkSession, map_path), weights)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )


def with_shards(
    docs: DataFrame,
    map_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
) -> DataFrame:
    """The documents themselves with size, virtual_slot, shard and map_version added; they do not shuffle.

    A null text is 8 bytes, as an empty one. Rows equal in id and text share a slot. An empty table
    gives an empty result. Where a document has a column of one of these names, the new one is
    called ``shard_...``.
    """
    records = record_slots(docs, id_col, text_col, slots)
    weights = stored(slot_weights(records.select("virtual_slot", "size"), slots), "slot-weights")
    save_map(first_map(weights, shards), map_path)
    names = docs.columns
    size, _, slot = _slot(docs[id_col], docs[text_col], slots)
    rows = docs.select(*(docs[c].alias(f"c{k}") for k, c in enumerate(names)), size.alias("size"), slot.alias("virtual_slot"))
    # one row per slot: bounded by the number of slots
    joined = rows.join(F.broadcast(load_map(docs.sparkSession, map_path)), "virtual_slot")
    taken = {c.lower() for c in names}
    added = {c: c if c not in taken else f"shard_{c}" for c in ("size", "virtual_slot", "shard", "map_version")}
    return joined.withColumnRenamed("version", "map_version").select(
        *(F.col(f"c{k}").alias(c) for k, c in enumerate(names)), *(F.col(c).alias(a) for c, a in added.items())
    )
