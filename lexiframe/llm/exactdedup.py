"""Exact dedup by two passes over hashes and a Bloom filter.

Pass one counts rows per filter cell. Cells hit twice go into a blocked Bloom
filter of a fixed largest size, which is broadcast. Pass two tests every row's
hash: rows that miss the filter are unique for certain and pass straight through,
only the others are grouped by their full digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import hex_number, lower_az, stored

#: Cells of the counting pass: 2 to this power. At 30 billion rows three in a hundred share one by chance.
CELL_BITS = 40
#: A filter block is one bitmap of Spark's bitmap functions: 32,768 bits, 4 KB.
BLOCK_BITS = 15
#: The filter has 16 bits per repeated cell, but never more blocks than this (128 MB broadcast).
#: A fuller filter lets more rows through to grouping; results stay the same.
MAX_BLOCKS = 1 << 15
MIN_BLOCKS = 1 << 5
BITS_PER_CELL = 16


def filter_blocks(repeated: int, max_blocks: int = MAX_BLOCKS) -> int:
    """Blocks for so many repeated cells: a power of two between the bounds."""
    wanted = max(1, repeated * BITS_PER_CELL >> BLOCK_BITS)
    return min(max_blocks, max(MIN_BLOCKS, 1 << (wanted - 1).bit_length()))


def _places(cell: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a cell and its two bits there."""
    mixed = F.xxhash64(cell)
    bit = lambda shift: F.shiftrightunsigned(mixed, shift).bitwiseAND((1 << BLOCK_BITS) - 1)
    return F.pmod(F.shiftrightunsigned(mixed, 31), F.lit(blocks)), bit(0), bit(15)


def repeated_cells(rows: DataFrame) -> DataFrame:
    """Cells hit by two rows or more. Copies meet in the map-side sum, so a hot text is no hot task."""
    return rows.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")


def bloom_filter(cells: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): at most ``blocks`` bitmaps of 4 KB."""
    block, one, two = _places(F.col("cell"), blocks)
    bits = cells.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def maybe_repeated(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Add ``maybe``: false only for rows whose cell was hit once."""
    block, one, two = _places(F.col("cell"), blocks)

    def is_set(bit: Column) -> Column:
        byte = F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1)))
        return F.getbit(F.conv(byte, 16, 10).cast("int"), bit.bitwiseAND(7).cast("int")) == 1

    # the bitmaps are bounded by MAX_BLOCKS blocks
    joined = rows.withColumn("block", block).join(F.broadcast(bloom), "block", "left")
    return joined.withColumn("maybe", F.coalesce(is_set(one) & is_set(two), F.lit(False))).drop("block", "bits")


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_blocks: int = MAX_BLOCKS
) -> DataFrame:
    """One row per document: which copy of its text stays.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty, and empty texts are copies of each other. Of equal texts the row with
    the largest id stays; a null id counts as smallest; of rows that also share
    their id exactly one stays. Only the two named columns are read, so others may
    have any name. An empty table gives an empty result.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    digest = F.sha2(lower_az(F.coalesce(docs[text_col], F.lit(""))), 256)
    hashed = docs.select(docs[id_col].alias("doc_id"), digest.alias("text_sha256"))
    cell = hex_number(F.col("text_sha256"), 1, CELL_BITS // 4)
    rows = stored(hashed.select("*", cell.alias("cell"), F.monotonically_increasing_id().alias("row")), "hashes")

    cells = stored(repeated_cells(rows), "repeated-cells")
    blocks = filter_blocks(cells.count(), max_blocks)
    tested = maybe_repeated(rows, stored(bloom_filter(cells, blocks), "bloom-filter"), blocks)

    best = F.max(F.struct("doc_id", "row"))
    groups = tested.filter("maybe").groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1"), "copy-groups")  # read anew, so that a hot text's rows can be split
    alone = F.col("n").isNull()
    grouped = tested.filter("maybe").join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
    )
    passed = tested.filter("NOT maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return passed.unionByName(grouped)
