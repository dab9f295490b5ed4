"""Draws documents whose words resemble a target text, by importance weights over hashed word runs.

Words go to buckets. A bucket's gain says how much likelier it is in the target
than in the source; a document's weight is the mean gain of its runs, looked up in
an array. With a random number added to each weight, the highest scores are a draw
without replacement. The score that parts drawn from undrawn documents is found by
narrowing an interval: each job counts the stored scores above a few thresholds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.llm.common import hex_number, stored

BUCKETS = 10_000
SEED = "2024"
#: Words of a run, at most; share of a hundred to draw; words a document needs to be drawn.
LONGEST, SHARE, FEWEST_WORDS = 1, 10, 20
#: Pieces into which a counting job cuts the interval.
CUTS = 16
#: Bytes of a text that are cut into words together.
STRETCH = 1 << 20

# lower case for A-Z; digits, letters and all bytes beyond ASCII stay; others become blanks
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a stretch at a time."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):  # to the end of the word
            while end < len(text) and _WORD_BYTES[text[end]] != 0x20:
                end += 1
        yield text[at:end].translate(_WORD_BYTES).split()
        at = end


def feature_buckets(text: bytes, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of all runs of 1 to ``longest`` words) of each stretch of a text."""
    before: list[bytes] = []
    for found in words(text):
        runs = found
        if longest > 1:
            line = before + found
            runs = [
                b" ".join(line[k - n : k]) for k in range(len(before) + 1, len(line) + 1) for n in range(1, min(longest, k) + 1)
            ]
            before = line[-(longest - 1) :]
        yield len(found), np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % BUCKETS


def bucket_counts(texts: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """Runs in each bucket over a table of texts (bytes). Tasks sum before the shuffle."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), longest):
                    total += np.bincount(found, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    summed = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    all_source, all_target = float(source.sum()), float(target.sum())
    ratio = lambda s, t: ((t + 1.0) * (all_source + BUCKETS)) / ((s + 1.0) * (all_target + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(rows: DataFrame, table: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of (doc_id, text as bytes)."""
    shared = rows.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers
    names = ["n_words", "n_features", "weight"]
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            done = np.zeros((3, batch.num_rows), np.int64)
            for k, text in enumerate(batch.column(1)):
                n_words, n_features, total = 0, 0, 0
                for n, found in feature_buckets(text.as_py(), longest):
                    n_words, n_features, total = n_words + n, n_features + len(found), total + int(gain[found].sum())
                done[:, k] = n_words, n_features, total // n_features if n_features else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, done)], ["doc_id", *names])

    return rows.mapInArrow(run, schema)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) that seed and id decide; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (hex_number(digest, 1, 8).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def threshold(rows: DataFrame, key: str, need: int, cuts: int = CUTS) -> tuple[int, int]:
    """(cut, above): the ``need``-th highest value of an integer column, and how many rows are above it.

    ``rows`` is a stored table with at least ``need`` rows and ``need`` is at least 1. Each
    job counts the rows at or above a few thresholds inside the interval, which then
    shrinks to one piece. Only the column itself is read.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    # at least ``need`` rows are >= low; fewer are >= high + 1
    high += 1
    above = 0
    while high - low > 1:
        marks = sorted({low + (high - low) * k // cuts for k in range(1, cuts)} - {low, high})
        counts = rows.filter(F.col(key) >= marks[0]).agg(*(F.count(F.when(F.col(key) >= m, 1)) for m in marks)).first()
        for mark, n in zip(marks, counts):
            if n >= need:
                low = mark
            else:
                high, above = mark, n
                break
    return low, above


def drawn(scored: DataFrame, need: int, cuts: int = CUTS) -> Column:
    """The condition that holds for the ``need`` first rows by score (highest), doc_id (smallest, null last) and row.

    ``scored`` is a stored table with score, doc_id (an integer) and row (unique). Ties at the
    cut are narrowed in the same way: first on the id, then, where rows repeat an id, on the
    row number.
    """
    if need <= 0:
        return F.lit(False)
    score, above = threshold(scored, "score", need, cuts)
    tied, left = scored.filter(F.col("score") == score), need - above
    higher, level = F.col("score") > score, F.col("score") == score
    # ~x reverses the order of integers
    ids = tied.filter("doc_id IS NOT NULL").select(F.bitwise_not(F.col("doc_id").cast("long")).alias("key"), "row")
    n_ids = ids.count()
    if left <= n_ids:
        cut, above = threshold(ids, "key", left, cuts)
        mine, last = F.col("doc_id") < ~cut, F.col("doc_id") == ~cut
        same, left = ids.filter(F.col("key") == cut), left - above
    else:
        mine, last = F.col("doc_id").isNotNull(), F.col("doc_id").isNull()
        same, left = tied.filter("doc_id IS NULL"), left - n_ids
    row, _ = threshold(same.select(F.bitwise_not("row").alias("key")), "key", left, cuts)
    inside = mine | (last & (F.col("row") <= ~row))
    return F.coalesce(higher | (level & inside), F.lit(False))


def with_ranks(rows: DataFrame) -> DataFrame:
    """Number the rows 1, 2, 3 ... by score (highest), doc_id (smallest, null last) and row.

    Rows are dealt by ranges of that order and sorted in their part; a part's first
    number follows from the parts before it. The order is unique, so no part is hot.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()),
        "resample-ranges",
    )
    part = F.shiftright("place", 33)
    sizes = sorted(map(tuple, placed.groupBy(part.alias("part")).count().collect()))  # one row per part
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    table = rows.sparkSession.createDataFrame(starts, "part int, start long")
    numbered = placed.withColumn("part", part.cast("int")).join(F.broadcast(table), "part")  # one row per part
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("rank", F.col("start") + within + 1).drop("part", "start", "place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    share: int = SHARE,
    fewest_words: int = FEWEST_WORDS,
    longest: int = LONGEST,
    seed: str = SEED,
    cuts: int = CUTS,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where it was not drawn).

    ``share`` percent of the documents with at least ``fewest_words`` words are drawn. Null and
    empty texts have no words and weigh 0. Of equal scores the smaller id comes first, a null
    id last, and rows that repeat an id come in the order in which they were stored. An empty
    target gives every bucket the source's inverse share; an empty table gives an empty
    result. Ids are integers; only the named columns are read.
    """
    as_bytes = lambda df, c: F.coalesce(df[c], F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("doc_id"), as_bytes(docs, text_col).alias("text"))
    wanted = target.select(as_bytes(target, target_text_col).alias("text"))
    table = gains(bucket_counts(rows.select("text"), longest), bucket_counts(wanted, longest))
    scored = stored(
        weighted(rows, table, longest)
        .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
        .withColumn("row", F.monotonically_increasing_id()),
        "resample-scores",
    )
    usable = F.col("n_words") >= fewest_words
    number = scored.filter(usable).count()
    chosen = usable & drawn(scored.filter(usable), share * number // 100, cuts)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = with_ranks(scored.filter(chosen)).select(*columns, "rank")
    others = scored.filter(~chosen).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)
