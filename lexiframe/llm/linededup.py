"""Line dedup by an exact set-similarity join.

Lines are sets of tokens. Tokens are ordered from rare to frequent by counts over
the whole corpus. Two lines can only be similar if the rarest tokens of both, a
prefix as long as the threshold demands, share one; lines meet there by an
equi-join on the token. Length and the places of the shared token rule most pairs
out inside the join, the rest is verified on the whole sets.

Equal lines are one representative before the join, so a line that stands in a
third of all documents meets nobody.

A line goes for one earlier match, so a group of similar lines need not be paired in
full. Lines that share a min-hash key first meet the earliest line with that key
alone; those that are similar to it are settled. The join then makes only pairs with a
line that is not settled. No line is judged by a key: what the keys miss, the join finds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.llm.bytewords import mix, portions, words_of
from lexiframe.llm.common import stored
from lexiframe.llm.exactdedup import bloom_filter, filter_blocks, maybe_repeated

#: The Jaccard similarity from which lines match, 4/5, in whole numbers.
OVER, UNDER = 4, 5
#: Counters of token frequency, and how many go into one row. Tokens that share a counter look
#: a little more frequent; the order stays the same for all lines, so the join stays exact.
COUNTERS, ROW_COUNTERS = 1 << 20, 1 << 12
_PLACE = 1 << 24
#: Longs of the bitmap that every line's tokens are hashed into: half into the first, which the
#: candidate join carries, the rest shared among the others.
BITMAP = 3
#: Min-hash keys of a line, and the minima in each, of the rarer half of its tokens. Halves with similarity J
#: share one with probability 1 - (1 - J ** MINIMA) ** KEYS: 0.98 for 0.9.
KEYS, MINIMA = 3, 3
#: Bits of a line number inside a portion, of a frequency class, and of a token's hash behind them.
_LINE, _CLASS, _HASH = 12, 8, 44


def token_counts(texts: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """Token counts of a table of texts (bytes), in a table of fixed size.

    Every task counts into an array of its own and emits it in slices; slices are
    added up where they meet.
    """
    width = min(counters, ROW_COUNTERS)

    def sliced(total):
        rows = [k for k in range(counters // width) if total[k * width : (k + 1) * width].any()]
        cells = [np.minimum(total[k * width : (k + 1) * width], 2**31 - 1).astype(np.int32).tobytes() for k in rows]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cells, pa.binary())], ["slice", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            for a, b in portions(texts):
                hashes, _, _ = words_of(b" ".join(texts[a:b]))
                np.add.at(total, _counter(hashes, counters), 1)
        yield sliced(total)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k * width : (k + 1) * width] += np.frombuffer(cells, np.int32)
        yield sliced(total)

    slices = texts.mapInArrow(count, "slice int, counts binary").repartition("slice")
    total = np.zeros(counters, np.int64)
    found = slices.mapInArrow(add, "slice int, counts binary").toArrow()  # at most ``counters`` numbers
    for k, cells in zip(found["slice"].to_pylist(), found["counts"].to_pylist()):
        total[k * width : (k + 1) * width] += np.frombuffer(cells, np.int32)
    return total


def _counter(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes & np.uint64(counters - 1)).astype(np.int64)


def _classes(counts: np.ndarray) -> np.ndarray:
    """Frequency classes: 0 for one occurrence, then eighths of a power of two."""
    return np.minimum(255, np.where(counts <= 1, 0, 1 + 8 * np.log2(np.maximum(counts, 2)))).astype(np.uint8)


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most 2 ** _LINE lines; a text with more is a run of its own."""
    for a, b in portions(texts):
        at, lines = a, 0
        for k in range(a, b):
            more = texts[k].count(b"\n") + 1
            if k > at and lines + more > 1 << _LINE:
                yield at, k
                at, lines = k, 0
            lines += more
        yield at, b


def _line_tokens(joined: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash, line) of every token of texts joined by line feeds, and the number of lines."""
    hashes, begins, _ = words_of(joined)
    feeds = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x0A)
    return hashes, np.searchsorted(feeds, begins), len(feeds) + 1


def _line_sets(joined: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of each line, rare ones first: (line, token) and the tokens per line.

    A token is its frequency class before the upper bits of its hash, so one sort of
    line and token orders lines and tokens and brings doubles together.
    """
    hashes, line, lines = _line_tokens(joined)
    kind = classes[_counter(hashes, len(classes))].astype(np.uint64)
    token = (kind << np.uint64(_HASH)) | (hashes >> np.uint64(64 - _HASH))
    out, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    width, mask = np.uint64(_CLASS + _HASH), np.uint64((1 << (_CLASS + _HASH)) - 1)
    # a portion has one run of lines, but for a text of very many
    for low in range(0, lines, 1 << _LINE):
        a, b = np.searchsorted(line, [low, low + (1 << _LINE)])
        key = np.sort(((line[a:b] - low).astype(np.uint64) << width) | token[a:b])
        key = key[np.diff(key, prepend=~key[:1]) != 0] if len(key) else key
        out.append(key & mask)
        owners.append((key >> width).astype(np.int64) + low)
    owner = np.concatenate(owners)
    return owner, np.concatenate(out), np.bincount(owner, minlength=lines)


def _summed(owner: np.ndarray, values: np.ndarray, lines: int, how=np.add) -> np.ndarray:
    sums = np.zeros(lines, np.uint64)
    if len(owner):
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        sums[owner[begins]] = how.reduceat(values, begins)
    return sums


def _set_keys(owner: np.ndarray, tokens: np.ndarray, lines: int) -> list[pa.Array]:
    """Two 64-bit sums over the tokens of a line: equal sets have equal keys."""
    both = (mix(tokens + np.uint64(seed)) for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
    return [pa.array(_summed(owner, m, lines).view(np.int64)) for m in both]


def _bitmaps(owner: np.ndarray, tokens: np.ndarray, lines: int) -> np.ndarray:
    """lines x BITMAP longs with a bit for each token."""
    where = mix(tokens ^ np.uint64(0xA0761D6478BD642F))
    share = (where >> np.uint64(6)) % np.uint64(2 * BITMAP - 2)
    out = np.zeros((lines, BITMAP), np.uint64)
    for k in range(BITMAP):
        here = share >= BITMAP - 1 if k == 0 else share == k - 1
        out[:, k] = _summed(owner[here], np.uint64(1) << (where[here] & np.uint64(63)), lines, np.bitwise_or)
    return out.view(np.int64)


def _min_hashes(owner: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lines x KEYS longs, each of MINIMA tokens of the rarer half that come first in an order of their own.

    Frequent tokens bring together lines that have little else in common.
    """
    out = np.zeros((len(n), KEYS), np.uint64)
    rarer = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) < ((n + 1) // 2)[owner]
    owner, tokens = owner[rarer], tokens[rarer]
    if len(owner):
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        mixed = mix(tokens ^ np.uint64(0xE7037ED1A0B428DB))
        odd = mix(np.arange(1, KEYS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
        for k, factor in enumerate(odd):
            at = (owner[begins], k // MINIMA)
            out[at] = mix(out[at] ^ np.minimum.reduceat(mixed * factor, begins))
    return out.view(np.int64)


def _prefixes(owner, tokens, n) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of every line that can have a partner other than itself, as 32-bit tokens.

    A token counted once in the corpus (class 0) shares with nobody; it keeps its
    place as a 0, which is no other token's number.
    """
    size = np.where(n >= OVER, n - (OVER * n + UNDER - 1) // UNDER + 1, 0)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    kept = tokens[inner < size[owner]]
    short = (mix(kept) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    short[short == 0] = 1
    return size, np.where(kept >> np.uint64(_HASH) == 0, 0, short).astype(np.int32)


def lines_of(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """One row per line of (doc_id, text): digest of the text, line, key of its token set, n, bitmap, prefix, min-hash keys."""
    id_field = rows.schema.fields[0]
    fields = [
        ("digest", T.LongType()), ("line", T.IntegerType()), ("high", T.LongType()), ("low", T.LongType()),
        ("n", T.IntegerType()), *((f"bits{k}", T.LongType()) for k in range(BITMAP)), ("prefix", T.ArrayType(T.IntegerType())),
        ("keys", T.ArrayType(T.LongType())),
    ]
    schema = T.StructType([id_field, *(T.StructField(*f) for f in fields)])
    shared = rows.sparkSession.sparkContext.broadcast(_classes(counts))  # COUNTERS bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in _portions(texts):
                per = np.array([t.count(b"\n") + 1 for t in texts[a:b]], np.int64)
                owner, tokens, n = _line_sets(b"\n".join(texts[a:b]), shared.value)
                size, prefix = _prefixes(owner, tokens, n)
                doc = np.repeat(np.arange(b - a), per)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                digests = np.array([xxhash.xxh64_intdigest(t) for t in texts[a:b]], np.uint64).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                maps = _bitmaps(owner, tokens, len(n))
                keys = _min_hashes(owner, tokens, n).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(digests[doc]), pa.array(number.astype(np.int32)),
                        *_set_keys(owner, tokens, len(n)), pa.array(n.astype(np.int32)), *(pa.array(maps[:, k].copy()) for k in range(BITMAP)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, KEYS, dtype=np.int32)), pa.array(keys)),
                    ],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def _whole_sets(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """(high, low, tokens) of every line of (doc_id, text) that has tokens: their full hashes."""
    shared = rows.sparkSession.sparkContext.broadcast(_classes(counts))  # COUNTERS bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in _portions(texts):
                joined = b"\n".join(texts[a:b])
                owner, tokens, n = _line_sets(joined, shared.value)
                hashes, line, lines = _line_tokens(joined)
                ends = np.searchsorted(line, np.arange(lines + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*_set_keys(owner, tokens, lines), lists], ["high", "low", "tokens"])

    return rows.mapInArrow(run, "high long, low long, tokens array<long>").filter(F.size("tokens") > 0)


def to_earliest(reps: DataFrame) -> DataFrame:
    """Pairs (a, b): line b beside the earliest line a that has a min-hash key of b, if their bitmaps may be similar.

    One row per line and key at most, however many lines share a key.
    """
    bits = [f"bits{k}" for k in range(BITMAP)]
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("lines")).filter("lines > 1").select("key"), "shared-keys")
    some = stored(keyed.join(shared, "key"), "shared-key-lines")
    some = stored(some.join(reps.select("rep", "first", "n", *bits), "rep"), "shared-key-sizes")
    earliest = stored(some.groupBy("key").agg(F.min(F.struct("first", "rep", "n", *bits)).alias("x")), "earliest-lines")
    differ = sum((F.bit_count(F.col(f"x.{name}").bitwiseXOR(F.col(name))) for name in bits), F.lit(0))
    tried = some.select("key", "rep", "n", *bits).join(earliest, "key").filter(F.col("rep") != F.col("x.rep"))
    tried = tried.filter(differ * (OVER + UNDER) <= (F.col("x.n") + F.col("n")) * (UNDER - OVER))
    return tried.select(F.col("x.rep").alias("a"), F.col("rep").alias("b")).distinct()


def candidates(reps: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of lines, a not longer than b, that pass the prefix, length and position filters and the first bitmap.

    Pairs of two ``settled`` lines (rep) are left out; ``asks`` is 1 if a is not settled, 2 if b is not, 3 if both. The rows carry half the bitmap, so
    that most pairs go inside the join, before any is shuffled.
    """
    reps = reps.select("rep", "n", "bits0", "prefix")
    if settled is None:
        reps = reps.withColumn("open", F.lit(1))
    else:
        reps = reps.join(settled.select("rep", F.lit(0).alias("open")), "rep", "left").withColumn("open", F.coalesce("open", F.lit(1)))
    placed = reps.select("rep", "n", "bits0", "open", F.posexplode("prefix").alias("place", "token")).filter("token <> 0")
    size = (F.col("n").cast("long") * _PLACE + F.col("place")) * 2 + F.col("open")
    rows = placed.select("token", "rep", size.alias("size"), "bits0")
    # the same rows on both sides: they are shuffled once and read twice
    sizes = {c: F.col(f"{c}.size") for c in "xy"}
    n = {c: F.shiftright(size, 25) for c, size in sizes.items()}
    left = {c: n[c] - F.shiftright(size, 1).bitwiseAND(_PLACE - 1) for c, size in sizes.items()}  # tokens from the shared one on
    pairs = rows.alias("x").join(
        rows.alias("y"),
        (F.col("x.token") == F.col("y.token"))
        & ((n["x"] < n["y"]) | ((n["x"] == n["y"]) & (F.col("x.rep") < F.col("y.rep"))))
        & (n["x"] * UNDER >= n["y"] * OVER)
        # |x & y| / |x | y| >= OVER / UNDER  means  |x & y| * (OVER + UNDER) >= (|x| + |y|) * OVER
        & (F.least(left["x"], left["y"]) * (OVER + UNDER) >= (n["x"] + n["y"]) * OVER)
        & (F.bit_count(F.col("x.bits0").bitwiseXOR(F.col("y.bits0"))) * (OVER + UNDER) <= (n["x"] + n["y"]) * (UNDER - OVER))
        & (sizes["x"].bitwiseOR(sizes["y"]).bitwiseAND(1) == 1),
    )
    asks = sizes["x"].bitwiseAND(1) + sizes["y"].bitwiseAND(1) * 2
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), asks.cast("int").alias("asks")).distinct()


def _overlapping(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose bitmaps leave enough tokens in common, the earlier line as a, if the later one is not settled.

    Every bit that only one line has stands for a token that only one line has, so
    no similar pair is lost.
    """
    bits = [f"bits{k}" for k in range(BITMAP)]
    one = reps.select(F.col("rep").alias("a"), F.struct("n", "first", *bits).alias("x"))
    two = reps.select(F.col("rep").alias("b"), F.struct("n", "first", *bits).alias("y"))
    differ: Column = F.lit(0)
    for name in bits:
        differ = differ + F.bit_count(F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}")))
    # |x ^ y| = |x| + |y| - 2 |x & y|
    joined = pairs.join(one, "a").join(two, "b").filter(differ * (OVER + UNDER) <= (F.col("x.n") + F.col("y.n")) * (UNDER - OVER))
    ordered = F.col("x.first") < F.col("y.first")
    joined = joined.filter(F.col("asks").bitwiseAND(F.when(ordered, 2).otherwise(1)) != 0)
    earlier, later = F.when(ordered, F.col("a")).otherwise(F.col("b")), F.when(ordered, F.col("b")).otherwise(F.col("a"))
    return joined.select(earlier.alias("a"), later.alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()


def _sets_of(rows: DataFrame, counts: np.ndarray, asked: DataFrame) -> DataFrame:
    """(rep, tokens) of the lines of ``asked`` (rep, high, low, wanted: the id of a document they are in)."""
    blocks = filter_blocks(asked.count())
    # only documents that may be wanted are cut, and only lines whose key may be among those asked for go on
    homes = stored(bloom_filter(asked.select(F.xxhash64("wanted").alias("cell")), blocks), "asked-homes")
    bloom = stored(bloom_filter(asked.select(F.col("low").alias("cell")), blocks), "asked-filter")
    texts = maybe_repeated(rows.withColumn("cell", F.xxhash64("doc_id")), homes, blocks).filter("maybe").select("doc_id", "text")
    some = maybe_repeated(_whole_sets(texts, counts).withColumn("cell", F.col("low")), bloom, blocks).filter("maybe")
    sets = some.join(asked.select("rep", "high", "low"), ["high", "low"]).groupBy("rep").agg(F.first("tokens").alias("tokens"))
    return stored(sets.withColumn("tokens", F.array_distinct("tokens")), "asked-sets")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole token sets are similar."""
    x = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(x, "a").join(y, "b")
    return joined.filter(shared * (OVER + UNDER) >= (F.size("x") + F.size("y")) * OVER).select("a", "b")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document with the numbers of the lines to remove, from 0.

    Lines end at a line feed. A line's tokens are its lower-cased (A-Z) parts between
    ASCII blanks, each once. A line is removed when an earlier line, in order of
    document id and line number, has a Jaccard similarity of 4/5 or more to it,
    whether or not that line is itself removed. Lines without tokens always stay. A
    null text is one empty line; null ids come last; of texts with one id the one
    whose hash is smaller comes first, and rows equal in id and text are the same
    document, judged alike. Only the two named columns are read. An empty table
    gives an empty result.

    Columns: doc_id, n_lines, n_removed, removed, digest (of the text).
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    counts = token_counts(rows.select("text"), counters)
    lines = stored(lines_of(rows, counts), "lines")
    here = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest", "line")
    distinct = lines.filter("n > 0").groupBy("high", "low").agg(
        F.min(here).alias("first"), F.count("*").alias("times"), F.first("n").alias("n"),
        *(F.first(f"bits{k}").alias(f"bits{k}") for k in range(BITMAP)), F.first("prefix").alias("prefix"),
        F.first("keys").alias("keys"),
    )
    reps = stored(distinct.withColumn("rep", F.monotonically_increasing_id()), "line-sets")

    wanted = reps.select("rep", "high", "low", F.col("first.doc_id").alias("wanted"))
    tried = stored(to_earliest(reps), "line-tries")
    known = _sets_of(rows, counts, stored(wanted.join(_ends(tried), "rep"), "asked-lines"))
    settled = stored(similar(tried, known).select(F.col("b").alias("rep")).distinct(), "settled-lines")

    pairs = stored(_overlapping(candidates(reps, settled), reps), "line-candidates")
    more = _ends(pairs).join(known.select("rep"), "rep", "left_anti")
    sets = known.unionByName(_sets_of(rows, counts, stored(wanted.join(more, "rep"), "asked-lines")))
    links = stored(similar(pairs, sets), "similar-lines")

    late = links.select(F.col("b").alias("rep")).unionByName(settled).distinct()
    status = reps.select("rep", "high", "low", "first", "times").join(late.withColumn("late", F.lit(True)), "rep", "left")
    status = stored(status.filter("times > 1 OR late").select("high", "low", "first", "late"), "line-status")

    # only lines whose key may be there more than once, or late, look their key up
    blocks = filter_blocks(status.count())
    bloom = stored(bloom_filter(status.select(F.col("low").alias("cell")), blocks), "status-filter")
    some = lines.filter("n > 0").select("doc_id", "digest", "line", "high", "low").withColumn("cell", F.col("low"))
    judged = maybe_repeated(some, bloom, blocks).filter("maybe").join(status, ["high", "low"])
    gone = judged.filter(F.coalesce("late", F.lit(False)) | (here > F.col("first")))
    gone = gone.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    texts = lines.groupBy("doc_id", "digest").agg(
        (F.max("line") + 1).cast("long").alias("n_lines"), F.count(F.when(F.col("line") == 0, 1)).alias("copies")
    )
    gone = gone.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "removed")
    found = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return each.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), "digest")
