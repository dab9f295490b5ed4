"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is the set of its five-word shingles, all of weight 1, however often they
occur. Every shingle is a Poisson process whose arrivals hit random registers; a
register keeps its first arrival. A shingle stops as soon as its next arrival is
later than all registers. Two documents agree in a register with their probability
Jaccard similarity, which for equal weights is the Jaccard similarity of the sets,
the one that is verified.

Texts of equal shingle sets are one representative from the start. Representatives that
agree in a whole band are candidates. They are verified on their shingle sets
against few hubs per band bucket, linked ones form classes, and what is in
different classes but in the same bucket is verified until nothing is left. A
bucket of thousands of near copies is therefore a star, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.llm.bytewords import mix, portions, words_of
from lexiframe.llm.common import stored
from lexiframe.llm.exactdedup import bloom_filter, filter_blocks, maybe_repeated

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares one of 36 bands of 7 registers with probability 0.9998.
BANDS, BAND_ROWS = 36, 7
REGISTERS = BANDS * BAND_ROWS
#: Bands whose hubs are verified in each of the first rounds.
ROUNDS = ((0, 3), (3, 12), (12, 36))
#: Sets smaller than this have no other set that similar than an equal one, and equal sets are one from the start.
FEWEST = 4
#: A sketch has one bit per cell of shingle hashes: whether the cell holds an odd number of the set's shingles.
#: Every bit in which two sketches differ stands for a shingle that only one of the sets has.
SKETCH_LONGS = 16
_KEY_BITS = 54

_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash) of the distinct shingles of each text, and two hashes of its whole set.

    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    each, begins, _ = words_of(b" ".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(ends, begins, "right")
    lengths = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(lengths) - lengths

    n = np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(lengths, SHINGLE)[doc]
    key = size.astype(np.uint64)
    for k in range(SHINGLE):
        there = k < size
        key[there] = key[there] * _STEP[0] + each[first[there] + k]
    key = mix(key) >> np.uint64(64 - _KEY_BITS)
    # one sort for both: at most 2 ** 10 documents at a time
    both = np.unique((doc.astype(np.uint64) << np.uint64(_KEY_BITS)) | key)
    doc, key = (both >> np.uint64(_KEY_BITS)).astype(np.int64), both & np.uint64((1 << _KEY_BITS) - 1)

    whole = np.zeros((len(texts), 2), np.uint64)
    begins = np.flatnonzero(np.diff(doc, prepend=-1))
    for k in range(2):
        whole[doc[begins], k] = np.add.reduceat(mix(key + _STEP[k]), begins) if len(begins) else 0
    return doc, key, whole


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, documents: int, registers: int = REGISTERS) -> np.ndarray:
    """documents x registers: the shingle that arrived first in each register.

    All shingles take their next arrivals together; those that cannot change their
    document's registers any more drop out. Who goes on for long is from a small
    document, so the number of arrivals taken at once doubles. A document without
    shingles keeps zeros.
    """
    first = np.full(documents * registers, np.inf)
    owner = np.zeros(documents * registers, np.uint64)
    time = np.zeros(len(key))
    rate = weight.astype(np.float64)
    step, width = 0, 1
    while len(key):
        steps = np.arange(step + 1, step + width + 1, dtype=np.uint64) * _STEP[1]
        drawn = mix((key * _STEP[0])[:, None] + steps)
        waits = -np.log((1.0 + (drawn >> np.uint64(12))) * 2.0**-52) / rate[:, None]
        times = time[:, None] + np.cumsum(waits, axis=1)
        slots = doc[:, None] * registers + (mix(drawn) % np.uint64(registers)).astype(np.int64)
        earlier = times < first[slots]
        when, where = times[earlier], slots[earlier]
        np.minimum.at(first, where, when)
        won = when == first[where]
        owner[where[won]] = np.broadcast_to(key[:, None], times.shape)[earlier][won]
        time = times[:, -1]
        last = first.reshape(documents, registers).max(axis=1)
        going = time < last[doc]
        doc, key, time, rate = doc[going], key[going], time[going], rate[going]
        step, width = step + width, min(64, max(1, step + width))
    return owner.reshape(documents, registers)


def signed(rows: DataFrame) -> DataFrame:
    """Add digest, n (distinct shingles), bands and sketch to (id, text, ...); the text stays for verification."""
    fields = [
        ("digest", T.StringType()), ("n", T.IntegerType()), ("bands", T.ArrayType(T.LongType())), ("sketch", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(*f) for f in fields)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, to in portions(texts):
                size = to - at
                doc, key, whole = shingle_sets(texts[at:to])
                n = np.bincount(doc, minlength=size)
                large = n[doc] >= FEWEST
                # one weight for all: what is estimated is what is verified
                table = signatures(doc[large], key[large], np.ones(large.sum()), size)
                band = np.zeros((size, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(BAND_ROWS):
                    band = mix(band * _STEP[0] + table[:, k::BAND_ROWS])
                cells = 64 * SKETCH_LONGS
                odd = np.bincount(doc * cells + (key % np.uint64(cells)).astype(np.int64), minlength=size * cells) & 1
                sketch = np.packbits(odd.astype(np.uint8).reshape(size, cells), axis=1)
                some = n >= FEWEST
                ends = lambda width: pa.array(np.concatenate(([0], np.cumsum(some * width))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(at, size).columns,
                        pa.array([f"{x:016x}{y:016x}" for x, y in whole.tolist()]),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(ends(BANDS), pa.array(band[some].reshape(-1).view(np.int64))),
                        pa.ListArray.from_arrays(ends(SKETCH_LONGS), pa.array(sketch[some].view(np.int64).reshape(-1))),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def _sets(rows: DataFrame) -> DataFrame:
    """(rep, text) to (rep, shingles): the distinct shingle hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, to in portions(texts):
                doc, key, _ = shingle_sets(texts[at:to])
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=to - at)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], ["rep", "shingles"])

    return rows.mapInArrow(run, "rep long, shingles array<long>")


# -- links and classes -----------------------------------------------------


def _alike(a: str, b: str) -> Column:
    """Sizes and sketches that leave a similarity of 0.8 possible; both are structs of n and sketch.

    No similar pair is lost: sets of n and m shingles with a Jaccard similarity s differ in
    (n + m) * (1 - s) / (1 + s) shingles, and their sketches in at most as many bits.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sized = F.least(n, m) >= F.greatest(n, m) * F.lit(SIMILARITY)
    differ = F.lit(0)
    for k in range(SKETCH_LONGS):
        part = F.get(F.col(f"{a}.sketch"), F.lit(k)).bitwiseXOR(F.get(F.col(f"{b}.sketch"), F.lit(k)))
        differ = differ + F.bit_count(part)
    return sized & (differ * (1 + SIMILARITY) <= (n + m) * (1 - SIMILARITY) + 1e-6)


def _first_shared(a: str, b: str) -> Column:
    """That no band before this one is shared as well: a pair meets in one bucket only."""
    before = (F.slice(F.col(f"{x}.bands"), 1, F.col("band")) for x in (a, b))
    return ~F.exists(F.zip_with(*before, lambda x, y: x == y), lambda same: same)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(right, "b").join(left, "a")
    return joined.filter(both >= (F.size("x") + F.size("y") - both) * F.lit(SIMILARITY)).select("a", "b")


def merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Give linked classes one label, the smallest.

    ``classes`` has (rep, class), ``links`` pairs (u, v) of classes. In each pass every
    linked class points to the smallest one it is linked to. Pointers go downwards, so they
    form trees; they are doubled until all point to the roots, and classes and links move
    there. A chain of classes becomes one in a logarithm of its length.
    """
    while not links.isEmpty():
        ways = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = ways.groupBy(F.col("u").alias("old")).agg(F.min("v").alias("new"))
        lowest = to_roots(stored(lowest.filter("new < old"), "class-moves"))
        to = lambda df, c: df.join(lowest.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        classes = stored(to(classes, "class"), "classes")
        links = to(to(links, "u"), "v").filter("u <> v")
        links = stored(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "class-links")
    return classes


def to_roots(moves: DataFrame) -> DataFrame:
    """Follow pointers (old, new) to their ends by doubling; ``new`` is always smaller than ``old``."""
    while True:
        further = moves.select(F.col("old").alias("new"), F.col("new").alias("next"))
        longer = moves.join(further, "new")
        if longer.isEmpty():
            return moves
        moves = stored(moves.join(further, "new", "left").select("old", F.coalesce("next", "new").alias("new")), "class-moves")


def _class_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between representatives as links between their classes."""
    a = classes.select(F.col("rep").alias("a"), F.col("class").alias("u"))
    b = classes.select(F.col("rep").alias("b"), F.col("class").alias("v"))
    return pairs.join(a, "a").join(b, "b").filter("u <> v").select("u", "v").distinct()


def near_classes(reps: DataFrame) -> DataFrame:
    """(rep, class) of all representatives that share a band with another one.

    ``reps`` has rep, text, n, bands and sketch.
    """
    exploded = reps.filter(F.col("n") >= FEWEST).select("rep", F.posexplode("bands").alias("band", "key"))
    buckets = exploded.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count("*").alias("members"))
    buckets = stored(buckets.filter("members > 1"), "band-buckets")
    entries = stored(exploded.join(buckets, ["band", "key"]), "band-entries")
    members = stored(entries.select("rep").distinct(), "near-members")
    sets = stored(_sets(reps.join(members, "rep").select("rep", "text")), "shingle-sets")
    facts = stored(reps.join(members, "rep").select("rep", F.struct("n", "sketch", "bands").alias("facts")), "near-facts")
    classes = members.select("rep", F.col("rep").alias("class"))

    def link(pairs, classes):
        """Verify pairs of different classes and merge the classes of those that are similar."""
        found = stored(verified(stored(pairs, "near-pairs"), sets), "near-links")
        return merged(classes, stored(_class_pairs(found, classes), "class-links"))

    for low, high in ROUNDS:
        a = classes.select(F.col("rep").alias("a"), F.col("class").alias("u"))
        b = classes.select(F.col("rep").alias("b"), F.col("class").alias("v"))
        here = entries.filter(F.col("band").between(low, high - 1) & (F.col("rep") != F.col("hub")))
        stars = here.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        stars = stars.join(a, "a").join(b, "b").filter("u <> v").select("a", "b")
        ours = facts.select(F.col("rep").alias("a"), F.col("facts").alias("ours"))
        theirs = facts.select(F.col("rep").alias("b"), F.col("facts").alias("theirs"))
        classes = link(stars.join(ours, "a").join(theirs, "b").filter(_alike("ours", "theirs")).select("a", "b"), classes)

    # buckets that still hold several classes: the pairs of members of different classes, hubs excepted
    held = entries.filter((F.col("members") > 2) & (F.col("rep") != F.col("hub"))).select("band", "key", "rep").join(classes, "rep")
    mixed = held.groupBy("band", "key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = stored(mixed.filter("low < high").select("band", "key"), "mixed-buckets")
    held = stored(held.join(mixed, ["band", "key"]).join(facts, "rep"), "mixed-entries")
    one = held.select("band", "key", F.col("rep").alias("a"), F.col("facts").alias("ours"), F.col("class").alias("u"))
    two = held.select(F.col("band").alias("band2"), F.col("key").alias("key2"), F.col("rep").alias("b"), F.col("facts").alias("theirs"), F.col("class").alias("v"))
    meet = (F.col("band") == F.col("band2")) & (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b")) & (F.col("u") != F.col("v"))
    rest = one.join(two, meet & _alike("ours", "theirs") & _first_shared("ours", "theirs"))
    return link(rest.select("a", "b"), classes)


def _classified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed rows of (doc_id, text, ...), and per digest its class: best row and size."""
    table = stored(signed(rows).withColumn("row", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    copies = table.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min(order).alias("best"))
    copies = stored(copies, "copies")
    reps = table.join(copies.select(F.col("rep").alias("row")), "row").select(F.col("row").alias("rep"), "text", "n", "bands", "sketch")
    labelled = copies.join(near_classes(reps), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    labelled = stored(labelled, "labelled")
    whole = labelled.groupBy("class").agg(F.min("best").alias("best"), F.sum("copies").alias("class_size"))
    named = labelled.select("digest", "class").join(stored(whole, "near-classes"), "class")
    return table, stored(named, "named")


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text"), *more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its class of near copies.

    Texts are near copies when their sets of five-word shingles (lower-cased A-Z,
    split at ASCII blanks) have a Jaccard similarity of 0.8 or more; classes are
    the connected texts. Texts of equal shingle sets are always of one class, so are all
    texts without words, null ones among them. A class is named by its smallest id
    and keeps the row of that id, a null id counting as largest; of rows that also
    share the id exactly one is kept. Only the two named columns are read. An empty
    table gives an empty result.

    Columns: doc_id, class_id, class_size, n_shingles, kept.
    """
    table, named = _classified(_rows(docs, id_col, text_col))
    return table.select("doc_id", "row", "digest", "n").join(named, "digest").select(
        "doc_id",
        F.col("best.doc_id").alias("class_id"),
        F.col("class_size").cast("long"),
        F.col("n").cast("long").alias("n_shingles"),
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each class the row that ``near_duplicates`` keeps, all columns.

    Texts without words, null ones among them, are one class, so one of them stays. Of repeated rows one
    stays. An empty table gives an empty result.
    """
    record = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col), F.lit(0).alias("none"))
    null = docs[text_col].isNull()
    table, named = _classified(_rows(docs, id_col, text_col, record.alias("record"), null.alias("null")))
    dropped = table.select("row", "digest").join(named, "digest").filter("row <> best.row").select("row")
    dropped = stored(dropped, "dropped-rows")
    columns = [
        F.when(~F.col("null"), F.col("text").cast("string")).alias(c) if c == text_col else F.col(f"record.c{k}").alias(c)
        for k, c in enumerate(docs.columns)
    ]
    # rows that miss the filter of dropped ones stay for certain and do not shuffle
    blocks = filter_blocks(dropped.count())
    bloom = stored(bloom_filter(dropped.select(F.col("row").alias("cell")), blocks), "dropped-filter")
    tested = maybe_repeated(table.select("row", "text", "record", "null", F.col("row").alias("cell")), bloom, blocks)
    rest = tested.filter("maybe").join(dropped, "row", "left_anti")
    return tested.filter("NOT maybe").select(*columns).unionByName(rest.select(*columns))
