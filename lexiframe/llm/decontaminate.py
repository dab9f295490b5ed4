"""Benchmark decontamination on a positional inverted index.

The index is built once over the training documents and stored. It is split by
document: a row is a block of documents with the sorted postings (positions) of
every term in it. Blocks are built and searched where the documents are, so
neither postings nor documents shuffle, and a frequent term is never one task.

A phrase is searched in a block from its rarest term: the positions of that term,
moved back by its place in the phrase, are the candidate starts; they are
intersected with the next rarest term's positions, moved by its place, and so on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.llm.common import stored

#: Words of a window; 1 in RATIO words of a contaminated document is inside one at least.
WINDOW = 13
RATIO = 20
#: Tokens after which a block of the index is closed. A document is never split.
BLOCK_TOKENS = 250_000
#: Index rows of a row group, which a reader holds at once.
GROUP_ROWS = 2
#: Bytes of test texts that one broadcast holds about; more texts are searched in several rounds.
ROUND_BYTES = 1_000_000
#: Candidate starts that are looked at together.
CANDIDATES = 1_000_000

# Bytes of words are 0-9, a-z and those of characters beyond ASCII; A-Z count as a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


# -- index -----------------------------------------------------------------


def _block(ids: list, lengths: list[int], tokens: list[bytes]) -> tuple:
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    starts = np.zeros(len(coded.dictionary) + 1, np.int32)
    np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)), out=starts[1:])
    first = np.zeros(len(ids) + 1, np.int32)
    np.cumsum(lengths, out=first[1:])
    return ids, first, coded.dictionary, starts, np.argsort(codes, kind="stable").astype(np.int32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The stored index: one row per block of documents.

    ``ids`` and ``first`` (where each document's tokens begin, one more entry than
    documents), ``terms``, ``starts`` (where each term's postings begin) and
    ``positions``; ``block`` numbers the rows. A null or empty text is a document without tokens. Only the two
    named columns are read.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("first", T.ArrayType(T.IntegerType())),
            T.StructField("terms", T.ArrayType(T.BinaryType())),
            T.StructField("starts", T.ArrayType(T.IntegerType())),
            T.StructField("positions", T.ArrayType(T.IntegerType())),
        ]
    )

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, tokens = [], [], []

        def row(kind):
            one = _block(ids, lengths, tokens)
            lists = [pa.array([one[0]], pa.list_(kind))]
            for values in one[1:]:
                values = values if isinstance(values, pa.Array) else pa.array(values)
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
            return pa.RecordBatch.from_arrays(lists, ["ids", "first", "terms", "starts", "positions"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                ids.append(doc)
                lengths.append(len(found))
                tokens.extend(found)
                if len(tokens) >= block_tokens:
                    yield row(kind)
                    ids, lengths, tokens = [], [], []
        if ids:
            yield row(kind)

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    blocks = texts.mapInArrow(build, schema).withColumn("block", F.monotonically_increasing_id())
    return stored(blocks, "positional-index", GROUP_ROWS)


# -- search ----------------------------------------------------------------


@dataclass
class Phrases:
    """Distinct phrases of test texts, by length, and whose they are."""

    vocabulary: list[bytes]
    #: length -> (phrases x length) places in the vocabulary
    tables: dict[int, np.ndarray]
    #: length -> per phrase the numbers of its owners
    owners: dict[int, list[list[int]]]
    names: list[str]


def windows_of(items: Iterable[tuple[str, bytes | None]], window: int = WINDOW) -> Phrases:
    """Every window of ``window`` words; a shorter text that has words is one window."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    found: dict[tuple[int, ...], set[int]] = {}
    for name, text in items:
        coded = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        number = names.setdefault(name, len(names))
        if coded:
            for k in range(max(1, len(coded) - window + 1)):
                found.setdefault(tuple(coded[k : k + window]), set()).add(number)
    tables: dict[int, list] = {}
    owners: dict[int, list] = {}
    for phrase, who in found.items():
        tables.setdefault(len(phrase), []).append(phrase)
        owners.setdefault(len(phrase), []).append(sorted(who))
    return Phrases(list(vocabulary), {n: np.array(t, np.int64) for n, t in tables.items()}, owners, list(names))


def find(first, starts, positions, local: np.ndarray, table: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position of its first word) of every occurrence in one block.

    ``local`` maps the phrases' vocabulary to the block's terms, -1 where it has
    none. With a ``slop`` every further word may be that many positions from where
    an exact occurrence would have it.
    """
    length, total = table.shape[1], int(first[-1])
    terms = local[table]
    there = np.flatnonzero((terms >= 0).all(axis=1))
    terms = terms[there]
    counts = np.diff(starts)
    order = np.argsort(counts[terms], axis=1, kind="stable")
    posted = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * total + positions  # ascending
    rarest = terms[np.arange(len(terms)), order[:, 0]]
    amounts = counts[rarest] * (2 * slop + 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    cuts = np.flatnonzero(np.diff(np.cumsum(amounts) // CANDIDATES, prepend=0)) if len(amounts) else []
    for part in np.split(np.arange(len(terms)), cuts):
        if not len(part):
            continue
        n = counts[rarest[part]]
        phrase = np.repeat(part, n)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        at = positions[starts[rarest[phrase]] + within].astype(np.int64) - order[phrase, 0]
        if slop:
            phrase = np.repeat(phrase, 2 * slop + 1)
            at = (at[:, None] + np.arange(-slop, slop + 1)).ravel()
        for j in range(0 if slop else 1, length):
            place = order[phrase, j]
            reach = np.where(place == 0, 0, slop)
            wanted = at + place
            low = terms[phrase, place].astype(np.int64) * total
            ok = (at >= 0) & (at < total)
            ask = low + np.clip(wanted - reach, 0, total)
            hit = np.searchsorted(posted, ask)
            got = posted[np.minimum(hit, len(posted) - 1)]
            ok &= (hit < len(posted)) & (got >= ask) & (got <= low + np.minimum(wanted + reach, total - 1))
            phrase, at = phrase[ok], at[ok]
        if slop:  # every word must lie in the document of the first one
            phrase, at = _inside(first, starts, positions, posted, terms, phrase, at, length, slop, total)
        else:
            same = np.searchsorted(first, at, "right") == np.searchsorted(first, at + length - 1, "right")
            phrase, at = phrase[same], at[same]
        found.append((phrase, at))
    phrase = np.concatenate([p for p, _ in found])
    at = np.concatenate([a for _, a in found])
    unique = np.unique(phrase * (total + 1) + at)
    return there[unique // (total + 1)], unique % (total + 1)


def _inside(first, starts, positions, posted, terms, phrase, at, length, slop, total):
    """Keep near occurrences whose words all lie in one document."""
    doc = np.searchsorted(first, at, "right")
    low, high = first[doc - 1].astype(np.int64), first[doc].astype(np.int64)
    ok = np.ones(len(at), bool)
    for place in range(1, length):
        base = terms[phrase, place].astype(np.int64) * total
        ask = base + np.maximum(at + place - slop, low)
        hit = np.searchsorted(posted, ask)
        got = posted[np.minimum(hit, len(posted) - 1)]
        ok &= (hit < len(posted)) & (got >= ask) & (got <= base + np.minimum(at + place + slop, high - 1))
    return phrase[ok], at[ok]


def _blocks(batches: Iterable[pa.RecordBatch], vocabulary: pa.Array):
    for batch in batches:
        for k in range(batch.num_rows):
            ids, first, terms, starts, positions = (batch.column(c)[k].values for c in range(5))
            local = pc.index_in(vocabulary, value_set=terms.cast(pa.binary())).fill_null(-1).to_numpy()
            yield batch.column(5)[k].as_py(), ids, first.to_numpy(), starts.to_numpy(), positions.to_numpy(), local


def phrase_matches(index: DataFrame, phrases: Iterable[tuple[str, str]], slop: int = 0) -> DataFrame:
    """(id, phrase, position): where each of a bounded list of named phrases occurs.

    ``slop`` 0 finds exact phrases. Otherwise each word after the first may be up to
    ``slop`` positions from its exact place, inside the same document. Positions
    count words from 0. Null and empty texts hold no phrase, a repeated row gives its
    matches again, and an empty index gives none.
    """
    named = windows_of([(n, t.encode()) for n, t in phrases], window=1 << 30)
    schema = T.StructType(
        [
            T.StructField("id", index.schema["ids"].dataType.elementType),
            T.StructField("phrase", T.StringType()),
            T.StructField("position", T.LongType()),
        ]
    )

    def search(batches):
        vocabulary = pa.array(named.vocabulary, pa.binary())
        for _, ids, first, starts, positions, local in _blocks(batches, vocabulary):
            for length, table in named.tables.items():
                which, at = find(first, starts, positions, local, table, slop)
                doc = np.searchsorted(first, at, "right") - 1
                rows = [(d, o, a) for w, d, a in zip(which, doc, at - first[doc]) for o in named.owners[length][w]]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([r[0] for r in rows], pa.int64())),
                        pa.array([named.names[r[1]] for r in rows], pa.string()),
                        pa.array([r[2] for r in rows], pa.int64()),
                    ],
                    ["id", "phrase", "position"],
                )

    return index.mapInArrow(search, schema)


def _overlaps(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Per document: words, stretches of words inside an occurrence (from, to), owners of the occurrences."""
    fields = [
        ("block", T.LongType()),
        ("number", T.IntegerType()),
        ("doc_id", index.schema["ids"].dataType.elementType),
        ("n_words", T.LongType()),
        ("froms", T.ArrayType(T.IntegerType())),
        ("tos", T.ArrayType(T.IntegerType())),
        ("items", T.ArrayType(T.StringType())),
    ]
    schema = T.StructType([T.StructField(*f) for f in fields])
    shared = index.sparkSession.sparkContext.broadcast(phrases)  # bounded by ROUND_BYTES

    def lists(doc, values, documents):
        ends = np.zeros(documents + 1, np.int32)
        np.cumsum(np.bincount(doc, minlength=documents), out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), values)

    def search(batches):
        known = shared.value
        vocabulary, names = pa.array(known.vocabulary, pa.binary()), pa.array(known.names, pa.string())
        owned = {n: (np.cumsum([0, *map(len, o)]), np.array([x for y in o for x in y], np.int64)) for n, o in known.owners.items()}
        for block, ids, first, starts, positions, local in _blocks(batches, vocabulary):
            total, documents = int(first[-1]), len(ids)
            edge = np.zeros(total + 1, np.int32)
            pairs = []
            for length, table in known.tables.items():
                which, at = find(first, starts, positions, local, table)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                doc = np.searchsorted(first, at, "right") - 1
                offsets, flat = owned[length]
                n = offsets[which + 1] - offsets[which]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.repeat(doc, n) * len(names) + flat[np.repeat(offsets[which], n) + inner])
            inside = np.cumsum(edge[:total]) > 0
            before = np.concatenate(([False], inside[:-1]))
            opens = np.zeros(total, bool)
            opens[first[:-1][np.diff(first) > 0]] = True  # no stretch crosses documents
            begin = np.flatnonzero(inside & (~before | opens))
            after = np.concatenate((inside[1:], [False]))
            closes = np.concatenate((opens[1:], [True])) if total else opens
            end = np.flatnonzero(inside & (~after | closes)) + 1
            doc = np.searchsorted(first, begin, "right") - 1
            found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(documents, block, np.int64)),
                    pa.array(np.arange(documents, dtype=np.int32)),
                    ids,
                    pa.array(np.diff(first).astype(np.int64)),
                    lists(doc, pa.array((begin - first[doc]).astype(np.int32)), documents),
                    lists(doc, pa.array((end - first[doc]).astype(np.int32)), documents),
                    lists(found // max(1, len(names)), names.take(pa.array(found % max(1, len(names)))), documents),
                ],
                [f[0] for f in fields],
            )

    return index.mapInArrow(search, schema)


def _items(tests: DataFrame, item_col: str, text_col: str, round_bytes: int) -> tuple[DataFrame, int]:
    """(item, text), each pair once, and in how many rounds they are searched."""
    items = tests.select(
        F.coalesce(tests[item_col].cast("string"), F.lit("null")).alias("item"),
        F.coalesce(tests[text_col], F.lit("")).cast("binary").alias("text"),
    ).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return items, size // round_bytes + 1


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    ratio: int = RATIO,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """One row per document: how much of it lies inside windows of the test items.

    Null and empty texts have no words and are not contaminated; items without
    words match nothing. A document row equal to another is judged like it. Items
    with the same id are one item; items without an id share the name ``null``.
    Other columns are not read. An empty table gives an empty result, empty tests
    give documents without hits.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    index = build_index(docs, id_col, text_col)
    items, rounds = _items(tests, item_col, item_text_col, round_bytes)
    if rounds == 1:
        found = _overlaps(index, windows_of(items.collect(), window))  # at most round_bytes
        lengths = F.zip_with("froms", "tos", lambda a, b: b - a)
        n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, x: s + x)
    else:
        # every round searches all documents for its share of the texts, whosever they are; what it finds in a
        # document is put together, an item of several rounds once
        found = None
        for k in range(rounds):
            share = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(rounds)) == k)
            part = _overlaps(index, windows_of(share.collect(), window))
            found = part if found is None else found.unionByName(part)
        flat = lambda c: F.flatten(F.collect_list(c))
        together = (flat("froms").alias("froms"), flat("tos").alias("tos"), F.array_distinct(flat("items")).alias("items"))
        found = found.groupBy("block", "number").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *together
        )
        stretches = F.zip_with("froms", "tos", lambda a, b: F.sequence(a, b - 1))
        n_hit = F.size(F.array_distinct(F.flatten(stretches)))
    counted = found.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), "items")
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame,
    tests: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    ratio: int = RATIO,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """The documents that ``contamination`` does not find contaminated, with all their columns.

    The index of a block of documents is searched in the task that built it, so the
    documents themselves do not move. Test sets too large for one broadcast go by
    the stored index; then contaminated texts are taken out by a join. Null and empty
    texts stay, repeated rows stay or go together, an empty table stays empty, and so
    do all documents without tests.
    """
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    text = rows[names.index(text_col)]
    items, rounds = _items(tests, item_col, item_text_col, round_bytes)
    if rounds > 1:
        keyed = rows.withColumn("key", F.sha2(F.coalesce(text, F.lit("")), 256))
        found = contamination(keyed, tests, "key", f"c{names.index(text_col)}", item_col, item_text_col, window, ratio, round_bytes)
        gone = stored(found.filter("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
        return keyed.join(gone, "key", "left_anti").drop("key").toDF(*names)

    shared = docs.sparkSession.sparkContext.broadcast(windows_of(items.collect(), window))  # at most round_bytes
    at = names.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        vocabulary = pa.array(known.vocabulary, pa.binary())
        for batch in batches:
            found = [words((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(at).to_pylist()]
            lengths = np.array([len(w) for w in found], np.int64)
            _, first, terms, starts, positions = _block(found, lengths, [w for ws in found for w in ws])
            local = pc.index_in(vocabulary, value_set=terms).fill_null(-1).to_numpy()
            edge = np.zeros(int(first[-1]) + 1, np.int32)
            for length, table in known.tables.items():
                _, begin = find(first, starts, positions, local, table)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
            inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
            n_hit = inside[first[1:]] - inside[first[:-1]]
            yield batch.filter(pa.array(~((n_hit > 0) & (n_hit * ratio >= lengths))))

    return rows.mapInArrow(run, rows.schema).toDF(*names)
