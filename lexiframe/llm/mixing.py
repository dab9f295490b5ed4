"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size gives every document floor(r) whole
copies for certain. The rest of the target is drawn: each document has an
inclusion probability, unequal by size, and a random number; documents are ranked
by their random odds divided by their inclusion odds, and taken in that order
until the rest is used up.

The ranking is cut into blocks per source. Block sums say in which block a
source's cut falls, and only that block is sorted, so a source that owns most of
the corpus is still many small tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.common import SPACE, hex_number, stored

WEIGHTS = (3, 1, 2)
#: Words of the mix, as a multiple of the words there are.
SHARE = 1.5
#: A source's words are used so often at most.
MOST = 2
#: How far size shifts the odds: 0 makes all documents of a source equally likely.
TILT = 0.5
#: Passes that fill the gap left by a document too long for it.
FILLS = 3
#: Documents of a source that a block holds on average.
BLOCK_ROWS = 100_000
#: Sources up to which a table with one row per source is broadcast.
MOST_BROADCAST = 100_000


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(source, documents, source_size, weight, target) per source.

    ``sizes`` has (source, documents, source_size). Sources in code point order,
    null last, take the weights in turn. A target above ``most`` times its source
    stops there and the excess goes to the others by weight, until none is above:
    with sources in the order of their cap per weight, that is one pass of running
    sums. The table has one row per source.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(number, F.lit(len(weights))) + 1)
    ).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    filled = weighted.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(after).alias("weights"),
    ).withColumn("level", F.col("left") / F.col("weights"))
    full = F.col("cap") / F.col("weight") <= F.col("level")
    leveled = filled.withColumn("full", full).withColumn(
        "level", F.max(F.when(~full, F.col("level"))).over(whole)
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return leveled.select("source", "documents", "source_size", "weight", target.alias("target"))


def random_number(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) that id and seed decide."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (hex_number(digest, 1, 13).cast("double") + 0.5) / F.lit(float(1 << 52))


def _small(df: DataFrame) -> DataFrame:
    """A per-source table, broadcast where it has few enough rows to be."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def ranked(sized: DataFrame, targets: DataFrame, seed: str, tilt: float, block_rows: int) -> DataFrame:
    """Add source_size, target, copies (certain ones), place (the Pareto rank, in (0, 1)) and block."""
    share = F.col("target") / F.col("source_size")
    rates = targets.select(
        F.col("source").alias("s"),
        F.coalesce(F.floor(share), F.lit(0)).cast("long").alias("copies"),
        F.coalesce(share - F.floor(share), F.lit(0.0)).alias("rest"),
        (F.col("source_size") / F.col("documents")).alias("mean"),
        F.ceil(F.col("documents") / block_rows).alias("blocks"),
        "target",
        "source_size",
    )
    joined = sized.join(_small(rates), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rest, mean, size = F.col("rest"), F.col("mean"), F.col("size")
    chance = rest + F.least(rest, 1 - rest) * F.lit(tilt) * (size - mean) / (size + mean)
    u = random_number(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (chance / (1 - chance))
    placed = joined.withColumn("place", F.when(rest > 0, odds / (1 + odds)))
    block = F.least(F.floor(F.col("place") * F.col("blocks")), F.col("blocks") - 1)
    return placed.withColumn("block", block).drop("rest", "mean", "blocks")


def _cut(rows: DataFrame, gaps: DataFrame, first: bool) -> DataFrame:
    """Per source the last document that fits, in order of place, and the words up to it.

    After the first pass only documents behind the cut that are no longer than the
    gap come into question.
    """
    joined = rows.join(gaps.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    here = F.struct("place", "doc_id")
    if not first:
        joined = joined.filter(F.coalesce(here > F.col("cut"), F.lit(True)) & (F.col("size") <= F.col("gap")))
    joined = joined.filter(F.col("place").isNotNull())
    sums = joined.groupBy("source", "block").agg(
        F.sum("size").alias("sum"), F.max(here).alias("last"), F.first("gap").alias("gap")
    )
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = sums.withColumn("upto", F.sum("sum").over(upto))
    fits = F.col("upto") <= F.col("gap")
    edges = stored(
        blocks.groupBy("source").agg(
            F.max(F.when(fits, F.col("last"))).alias("last"),
            F.max(F.when(fits, F.col("upto"))).alias("words"),
            F.min(F.when(~fits, F.col("block"))).alias("edge"),
        ),
        "mix-edges",
    )
    inner = joined.join(
        edges.select(F.col("source").alias("e"), "edge", F.coalesce("words", F.lit(0)).alias("base")),
        F.col("source").eqNullSafe(F.col("e")) & (F.col("block") == F.col("edge")),
    )
    run = F.sum("size").over(Window.partitionBy("source").orderBy("place", "doc_id"))  # equals share their sum
    taken = inner.withColumn("words", F.col("base") + run).filter(F.col("words") <= F.col("gap"))
    ends = taken.groupBy("source").agg(F.max(F.struct("place", "doc_id")).alias("last"), F.max("words").alias("words"))
    both = edges.select("source", "last", "words").unionByName(ends).filter(F.col("last").isNotNull())
    return both.groupBy("source").agg(F.max("last").alias("last"), F.max("words").alias("words"))


@dataclass
class Plan:
    """What decides a mix: targets and cuts per source, and the settings of the ranking."""

    targets: DataFrame
    passes: list[DataFrame]
    seed: str
    tilt: float
    block_rows: int

    def copies(self, sized: DataFrame) -> DataFrame:
        """Add source_size, target and copies to rows of (doc_id, source, size, ...)."""
        out = ranked(sized, self.targets, self.seed, self.tilt, self.block_rows)
        chosen = F.lit(False)
        here = F.struct("place", "doc_id")
        for k, one in enumerate(self.passes):
            out = out.join(_small(one.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
            p = F.col(f"pass{k}")
            inside = here <= p["cut"]
            if k:
                inside = inside & F.coalesce(here > p["after"], F.lit(True)) & (F.col("size") <= p["had"])
            chosen = chosen | F.coalesce(inside, F.lit(False))
        copies = F.col("copies") + F.when(F.col("place").isNotNull() & chosen, 1).otherwise(0)
        return out.withColumn("copies", copies.cast("int")).select(*sized.columns, "source_size", "target", "copies")


def plan(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    tilt: float = TILT,
    seed: str = "mix",
    block_rows: int = BLOCK_ROWS,
) -> Plan:
    """The plan of a mix from (doc_id, source, size)."""
    sizes = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most), "targets")
    rows = stored(ranked(sized, targets, seed, tilt, block_rows).select("doc_id", "source", "size", "place", "block"), "ranked")
    share_of = F.col("target") / F.col("source_size")
    whole = F.coalesce(F.floor(share_of), F.lit(0)) * F.col("source_size")
    state = targets.select("source", (F.col("target") - whole).alias("gap")).withColumn(
        "cut", F.lit(None).cast(rows.select(F.struct("place", "doc_id").alias("c")).schema["c"].dataType)
    )
    passes = []
    for k in range(1 + FILLS):
        found = _cut(rows, state, first=k == 0).withColumnRenamed("source", "f")
        joined = state.join(found, F.col("source").eqNullSafe(F.col("f")), "left").select(
            "source", F.col("gap").alias("had"), F.col("cut").alias("after"),
            F.coalesce("last", "cut").alias("cut"), (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"),
        )
        state = stored(joined, "mix-state")
        passes.append(state.select("source", F.struct("had", "after", "cut").alias(f"pass{k}")))
    return Plan(targets, passes, seed, tilt, block_rows)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return stored(
        docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size")),
        "sizes",
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """One row per document with the words the mix takes of it.

    A document is taken whole, never in part. A null text has no words, a null
    source is a source of its own, null ids share one random number. Rows equal in
    id and source are taken together or not at all. Sources without words have
    target 0. Ids and seed decide everything, so reruns agree. Only the three named
    columns are read. An empty table gives an empty result. ``settings`` are those
    of ``plan``.

    Columns: doc_id, size, source_size, target, taken, source, copies.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    out = plan(sized, **settings).copies(sized)
    taken = (F.col("copies") * F.col("size")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns; they do not shuffle.

    Texts without words, null ones among them, have size 0 and add nothing to a target. A null
    source is a source. Repeated rows share their random number. An empty table gives an empty result.
    """
    decided = plan(_sized(docs, id_col, text_col, source_col), **settings)
    names = docs.columns
    rows = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"),
        *(docs[c].alias(f"c{k}") for k, c in enumerate(names)),
    )
    taken = decided.copies(rows).filter("copies > 0")
    repeated = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))
