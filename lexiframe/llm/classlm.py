"""Scores texts by a Brown class-based bigram model.

P(word | previous word) = P(class | previous class) * P(word | class).

Exchange clustering assigns the most frequent words to classes: it moves words between
classes as long as the likelihood of the training corpus grows, and needs only the
bigram counts of these words, a table whose size does not depend on the corpus. Every
other word of the corpus then gets its class by the same criterion: the classes that
stand before and after its occurrences are summed by word over the whole corpus, and
the word goes where they are likeliest. That is done first for the words whose classes
every task can hold, then, with their classes known, for all rarer ones. The classes of
all pairs of neighbours are counted, those of two rare words by joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.llm.common import stored
from lexiframe.llm.quality import remainder

#: Words that exchange clustering moves, and classes. One more word and class is the end.
OWN_WORDS, CLASSES = 1500, 64
#: Most words whose counts and classes every task holds; those of others come by a join.
HELD_WORDS = 1 << 17
ADDED, CLASS_ADDED = 0.1, 0.5
FLUSH_TOKENS = 400_000
#: Occurrences of words that a task gathers, six bytes each.
GATHERED = 1 << 22
#: One document in FOLDS is held out of the training corpus.
FOLDS = 10

END = b" "  # no word holds a space
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Split at the six ASCII blanks that bytes.split() knows: 0x20 and 0x09 to 0x0D."""
    return text.translate(_LOWER).split() if text else []


# -- exchange clustering ---------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int | None = None, full_totals: bool = False) -> np.ndarray:
    """Class of each unit, from the units' bigram counts. The last unit, the end, keeps class 0 to itself.

    Units start dealt out by frequency. One after the other, most frequent first,
    each goes to the class that makes the corpus likeliest, until none moves or
    ``sweeps`` are done. With ``full_totals`` the totals of the classes beside the unit keep
    what stands beside it, as whichever class it joins they do: then every move raises the
    likelihood, so there is an end. Without, moves may lower it and go in circles.
    """
    units = len(counts)
    totals = counts.sum(0) + counts.sum(1)
    order = [u for u in np.argsort(-totals, kind="stable") if u != units - 1]
    owner = np.zeros(units, np.int64)
    owner[order] = 1 + np.arange(units - 1) % (classes - 1)
    member = np.zeros((units, classes))
    member[np.arange(units), owner] = 1
    table = member.T @ counts @ member
    for _ in count() if sweeps is None else range(sweeps):
        moved = 0
        for u in order:
            if not totals[u]:
                continue
            to = np.bincount(owner, counts[u], classes)
            back = np.bincount(owner, counts[:, u], classes)
            own, home = float(counts[u, u]), owner[u]
            to[home] -= own
            back[home] -= own
            table[home] -= to
            table[:, home] -= back
            table[home, home] -= own
            rows, columns = table.sum(1), table.sum(0)
            if full_totals:
                rows, columns = rows + back, columns + to
            outs, ins = to.sum() + own, back.sum() + own
            gain = (_xlogx(table + to) - _xlogx(table)).sum(1) + (_xlogx(table + back[:, None]) - _xlogx(table)).sum(0)
            corner = np.diagonal(table)
            gain += _xlogx(corner + to + back + own) + _xlogx(corner) - _xlogx(corner + to) - _xlogx(corner + back)
            gain -= _xlogx(rows + outs) - _xlogx(rows) + _xlogx(columns + ins) - _xlogx(columns)
            gain[0] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[home] + 1e-9:
                best = home
            moved += best != home
            owner[u] = best
            table[best] += to
            table[:, best] += back
            table[best, best] += own
        if not moved:
            break
    return owner


# -- counting --------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a table of texts (bytes); the end is the word of one blank."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[bytes] = []

        def row():
            found = pa.array(tokens, pa.binary()).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens.extend(words(text))
                tokens.append(END)
                if len(tokens) >= FLUSH_TOKENS:
                    yield row()
                    tokens.clear()
        if tokens:
            yield row()

    counted = texts.mapInArrow(count, "word binary, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def most_frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words above the lowest count that leaves at most ``most`` of them, most frequent first, and the end."""
    levels = sorted(((r.n, r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True)  # one row per count
    floor, taken = 0, 0
    for n, number in levels:
        taken += number
        if taken > most:
            floor = n
            break
    rows = counts.filter((F.col("n") > floor) | (F.col("word") == END)).collect()  # at most ``most`` and the end
    return {bytes(r.word): r.n for r in sorted(rows, key=lambda r: (-r.n, bytes(r.word)))}


def _tables(rows: DataFrame, cells: int, count) -> np.ndarray:
    """Sum a table of ``cells`` numbers over all tasks; ``count`` adds a batch to its task's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            count(batch, total)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["cell", "n"])

    summed = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # at most ``cells`` rows
    counts = np.zeros(cells)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def coded(rows: DataFrame, held: list[bytes]) -> DataFrame:
    """The rows with (codes, others) in place of their last column, a text (bytes).

    ``codes`` has the places of the words in ``held``, four bytes each, and of the end after them; -1 stands
    for other words, which ``others`` lists in order. Texts are cut into words once for all passes over them.
    """
    schema = T.StructType(rows.schema.fields[:-1]).add("codes", T.BinaryType()).add("others", T.ArrayType(T.BinaryType()))
    shared = rows.sparkSession.sparkContext.broadcast(held)  # at most HELD_WORDS words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {w: k for k, w in enumerate(shared.value)}.get
        for batch in batches:
            tokens, lengths = [], [0]
            for text in batch.columns[-1].to_pylist():
                tokens += words(text)
                tokens.append(END)
                lengths.append(len(tokens))
            codes = np.fromiter(map(get, tokens, repeat(-1)), np.int32, len(tokens))
            missing = np.flatnonzero(codes < 0)
            cuts = pa.py_buffer(np.array(lengths, np.int32) * 4)
            ends = np.searchsorted(missing, lengths).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array([tokens[k] for k in missing.tolist()], pa.binary()))
            codes = pa.Array.from_buffers(pa.binary(), len(lengths) - 1, [None, cuts, pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes, lists], schema.names)

    return rows.mapInArrow(run, schema)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _by_code(held: Iterable[bytes], values: dict[bytes, int], other: int) -> np.ndarray:
    """A value for each word in ``held``, and last, where -1 points to, the one for other words."""
    return np.array([*(values.get(w, other) for w in held), other], np.int64)


def bigrams(texts: DataFrame, number_of: np.ndarray, n: int) -> np.ndarray:
    """How often a number follows a number over coded texts, an end before each; -1 is no number."""
    shared = texts.sparkSession.sparkContext.broadcast(number_of)  # at most HELD_WORDS numbers

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        codes = _codes(batch.column(0))
        if len(codes):
            x = shared.value[codes]
            before = np.concatenate((x[-1:], x[:-1]))  # the last one is an end
            both = (before >= 0) & (x >= 0)
            total += np.bincount(before[both] * n + x[both], minlength=n * n)

    return _tables(texts.select("codes"), n * n, count).reshape(n, n)


def _left_and_right(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes before and after each token of texts that each end with the end, class 0."""
    return np.concatenate(([0], classes[:-1])), np.concatenate((classes[1:], [0]))


NONE = 255  # a neighbour whose class is not known yet


def _packed(names: pa.Array, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    """Rows of (word, near) from each occurrence's word number and neighbours."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    near = np.ascontiguousarray(np.stack([left[order], right[order]], axis=1))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    cuts = np.append(first, len(owner)).astype(np.int32) * 2
    lists = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(near)])
    return pa.RecordBatch.from_arrays([names.take(pa.array(owner[first])), lists], ["word", "near"])


def neighbours(texts: DataFrame, classes: dict[bytes, int], wanted: list[bytes] | None) -> DataFrame:
    """(word, near): the classes before and after occurrences of words in texts (bytes), two bytes each.

    ``classes`` has the words whose class is known. Rows are of the words ``wanted``, or, where that is
    None, of all others.
    """
    held = list(dict.fromkeys([*classes, *(wanted or [])]))
    return coded_neighbours(coded(texts, held), held, classes, wanted)


def coded_neighbours(texts: DataFrame, held: list[bytes], classes: dict[bytes, int], wanted: list[bytes] | None) -> DataFrame:
    """The same from coded texts; where ``wanted`` is None, all of ``held`` have a class.

    A task gathers the occurrences of wanted words before it gives them on, as their numbers say which
    word is meant.
    """
    mine = None if wanted is None else _by_code(held, {w: k for k, w in enumerate(wanted)}, -1).astype(np.int32)
    # at most HELD_WORDS words
    shared = texts.sparkSession.sparkContext.broadcast((_by_code(held, classes, NONE).astype(np.uint8), mine, wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, mine, wanted = shared.value
        gathered, size = [], 0
        for batch in batches:
            codes = _codes(batch.column(0))
            left, right = (x.astype(np.uint8) for x in _left_and_right(class_of[codes]))
            if mine is None:
                others = batch.column(1).flatten().dictionary_encode()
                at = np.flatnonzero(codes < 0)
                if len(at):
                    yield _packed(others.dictionary, others.indices.to_numpy(), left[at], right[at])
                continue
            owner = mine[codes]
            at = np.flatnonzero(owner >= 0)
            gathered.append((owner[at], left[at], right[at]))
            size += len(at)
            if size >= GATHERED:
                yield _packed(pa.array(wanted, pa.binary()), *map(np.concatenate, zip(*gathered)))
                gathered, size = [], 0
        if gathered:
            yield _packed(pa.array(wanted, pa.binary()), *map(np.concatenate, zip(*gathered)))

    return texts.select("codes", "others").mapInArrow(run, "word binary, near binary")


def assigned(near: DataFrame, worth: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(word, class, n, beside, times): each word's likeliest class, its occurrences, and how often which class stood beside it (sparse).

    ``worth``: what a class before, and a class after, says for each class. A word's rows meet in one
    task in order, so only one word is held at a time; no word here is frequent enough to be hot.
    """
    shared = near.sparkSession.sparkContext.broadcast(worth)  # two tables of classes squared

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = shared.value
        carried, times, left, right = None, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            words_, near = batch.column(0), batch.column(1)
            coded = words_.dictionary_encode()
            number = coded.indices.to_numpy()  # in order of appearance, so runs count up
            sizes = pc.binary_length(near).to_numpy(zero_copy_only=False) // 2
            pairs = np.frombuffer(b"".join(near.to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
            owner, n = np.repeat(number, sizes), len(coded.dictionary)
            width = CLASSES
            sums = []
            for side in (0, 1):
                told = pairs[:, side] != NONE
                sums.append(np.bincount(owner[told] * width + pairs[told, side], minlength=n * width).reshape(n, width))
            known = coded.dictionary.to_pylist()
            occurs = np.bincount(owner, minlength=n)
            if carried is not None:
                if known[0] == carried:
                    occurs[0] += times
                    sums[0][0] += left
                    sums[1][0] += right
                else:
                    yield _classed([carried], np.array([times]), left[None], right[None], before, after)
            yield _classed(known[:-1], occurs[:-1], sums[0][:-1], sums[1][:-1], before, after)
            carried, times, left, right = known[-1], occurs[-1], sums[0][-1], sums[1][-1]
        if carried is not None:
            yield _classed([carried], np.array([times]), left[None], right[None], before, after)

    rows = near.repartition("word").sortWithinPartitions("word")
    return rows.mapInArrow(run, "word binary, class int, n long, beside array<int>, times array<int>")


def _classed(known: list[bytes], occurs: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    value = left @ before + right @ after
    value[:, 0] = -np.inf  # the end's own
    both = np.concatenate([left, right], axis=1)
    word, cell = np.nonzero(both)
    ends = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(known))))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell, both[word, cell])]
    classes = pa.array(value.argmax(1).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(known, pa.binary()), classes, pa.array(occurs, pa.int64()), *lists], ["word", "class", "n", "beside", "times"])


def rare_pairs(texts: DataFrame, others: DataFrame) -> DataFrame:
    """(before, class, n): how often a class follows a class where neither word is held, over coded texts.

    ``others`` has the classes of these words. Each pair goes to its first word, then to its second one;
    no word here is frequent enough to be hot.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(_codes(batch.column(0)) < 0)
            first = np.flatnonzero(np.diff(at) == 1)  # texts end with the end, which is held
            names = batch.column(1).flatten()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(first + k)) for k in (0, 1)], ["word", "next"])

    pairs = texts.select("codes", "others").mapInArrow(run, "word binary, next binary")
    known = others.select("word", "class")
    half = pairs.join(known.withColumnRenamed("class", "before"), "word").select("before", "next")
    return half.join(known.withColumnRenamed("word", "next"), "next").groupBy("before", "class").agg(F.count("*").alias("n"))


def worths(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a class before (rows) and after (rows) a word says for each class of the word: log ratios to chance."""
    table = steps + CLASS_ADDED
    ratio = np.log(table / (table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()))
    return ratio, ratio.T


# -- the model -------------------------------------------------------------


@dataclass
class Model:
    classes: dict[bytes, int]  # of the words that every task holds
    held: dict[bytes, int]  # their counts
    step: np.ndarray  # log10 P(class | previous class)
    below: np.ndarray  # per class log10 of the emission's denominator
    strange: int  # class of words that training texts do not have
    tokens: int
    types: int

    @property
    def base_below(self) -> float:
        return float(np.log10(self.tokens + ADDED * (self.types + 1)))


def fit(texts: DataFrame, held_words: int = HELD_WORDS) -> tuple[Model, DataFrame]:
    """The model, and (word, n, class) of the words that tasks do not hold, from a table of training texts (bytes)."""
    counts = word_counts(texts)
    held = held_of(counts, held_words)
    return learned(stored(coded(texts, list(held)), "coded-texts"), counts, held)


def held_of(counts: DataFrame, held_words: int) -> dict[bytes, int]:
    """The words that tasks hold, and the end, with their counts."""
    held = most_frequent(counts, held_words)
    held.setdefault(END, 0)
    return held


def learned(texts: DataFrame, counts: DataFrame, held: dict[bytes, int]) -> tuple[Model, DataFrame]:
    """The same from coded texts, their word counts and the words that tasks hold."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the end comes last, as exchange() wants it
    own = {w: k for k, w in enumerate([*[w for w in held if w != END][:OWN_WORDS], END])}
    pairs = bigrams(texts, _by_code(held, own, -1), len(own))
    owner = exchange(pairs, full_totals=True)
    classes = {w: int(owner[k]) for w, k in own.items()}
    steps = np.zeros((CLASSES, CLASSES))
    np.add.at(steps, (owner[:, None], owner[None, :]), pairs)

    rest = [w for w in held if w not in own]
    if rest:
        near = coded_neighbours(texts, list(held), classes, rest)
        found = assigned(near, worths(steps)).select("word", "class").collect()  # at most HELD_WORDS
        classes |= {bytes(r.word): r["class"] for r in found}
    steps = bigrams(texts, _by_code(held, classes, -1), CLASSES)
    rare = stored(assigned(coded_neighbours(texts, list(held), classes, None), worths(steps)), "rare-words")
    near = rare.select("class", F.explode(F.arrays_zip("beside", "times")).alias("x")).select("class", "x.*")
    for r in near.groupBy("class", "beside").agg(F.sum("times").alias("n")).collect():  # two classes squared
        side, other = divmod(r.beside, CLASSES)
        steps[(r["class"], other) if side else (other, r["class"])] += r.n

    others = rare.select("word", "n", "class")
    for r in rare_pairs(texts, others).collect():  # classes squared
        steps[r["before"], r["class"]] += r.n

    tokens_of, types_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for word, n in held.items():
        tokens_of[classes[word]] += n
        types_of[classes[word]] += n > 0
    rare_tokens = np.zeros(CLASSES)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # one row per class
        rare_tokens[r["class"]] += r.n
        types_of[r["class"]] += r.types
    tokens_of += rare_tokens
    steps += CLASS_ADDED
    below = np.log10(tokens_of + ADDED * (types_of + 1))
    strange = int(np.argmax(rare_tokens)) if rare_tokens.sum() else 1
    step = np.log10(steps / steps.sum(1, keepdims=True))
    return Model(classes, held, step, below, strange, totals[0], totals[1]), others


def _partial(rows: DataFrame, model: Model) -> DataFrame:
    """Per document (its id, codes, others) what the held words give, and the other words with their places and the classes beside them."""
    id_field = rows.schema.fields[0]
    fields = [("n_tokens", T.LongType()), ("known", T.LongType()), ("inner", T.DoubleType()), ("steps", T.DoubleType())]
    lists = [("others", T.BinaryType()), ("places", T.IntegerType()), ("lefts", T.IntegerType()), ("rights", T.IntegerType())]
    schema = T.StructType(
        [id_field, *(T.StructField(*f) for f in fields), *(T.StructField(n, T.ArrayType(t)) for n, t in lists)]
    )
    arrays = (_by_code(model.held, model.held, 0), _by_code(model.held, model.classes, -1), model.step, model.below)
    shared = rows.sparkSession.sparkContext.broadcast(arrays)  # bounded by HELD_WORDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of, class_of, step, below = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(batch.column(1))
            lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) // 4
            counts, classes = count_of[codes], class_of[codes]
            before, after = _left_and_right(classes)
            starts = np.cumsum(lengths) - lengths
            there = classes >= 0
            emitted = np.where(there, np.log10(counts + ADDED), 0.0)
            moves = np.where(there & (before >= 0), step[before, classes], 0.0) - np.where(there, below[classes], 0.0)
            missing = np.flatnonzero(~there)
            owner = np.searchsorted(starts, missing, "right") - 1
            ends = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(np.bincount(owner, minlength=len(lengths)), out=ends[1:])
            columns = [
                batch.column(2).flatten(),
                *(pa.array(x.astype(np.int32)) for x in (missing - starts[owner], before[missing], after[missing])),
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(emitted, starts)),
                    pa.array(np.add.reduceat(moves, starts)),
                    *(pa.ListArray.from_arrays(pa.array(ends), c) for c in columns),
                ],
                [f.name for f in schema.fields],
            )

    return rows.mapInArrow(run, schema)


def _rest(partial: DataFrame, others: DataFrame, model: Model) -> DataFrame:
    """(row, rest, rest_known, rest_steps): what the words give that tasks do not hold."""
    each = F.explode(F.arrays_zip("others", "places", "lefts", "rights")).alias("x")
    asked = partial.select("row", each).select("row", F.col("x.others").alias("word"), "x.places", "x.lefts", "x.rights")
    found = asked.join(others, "word", "left").withColumn("class", F.coalesce("class", F.lit(model.strange)))
    # where the word before is not held either, its class comes from the row before; a window is one document
    order = Window.partitionBy("row").orderBy("places")
    lefts = F.when(F.col("lefts") < 0, F.lag("class").over(order)).otherwise(F.col("lefts"))
    known = found.select("row", "n", "class", lefts.alias("left"), F.col("rights").alias("right"))
    shared = partial.sparkSession.sparkContext.broadcast((model.step, model.below))  # tables of classes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, below = shared.value
        for batch in batches:
            _, n, class_, left, right = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns)
            moves = step[left, class_] - below[class_] + np.where(right >= 0, step[class_, right], 0.0)
            columns = [pa.array(np.log10(n + ADDED)), pa.array((n > 0).astype(np.int64)), pa.array(moves)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "rest", "known", "moves"])

    scored = known.mapInArrow(run, "row long, rest double, known long, moves double")
    return scored.groupBy("row").agg(
        F.sum("rest").alias("rest"), F.sum("known").alias("rest_known"), F.sum("moves").alias("rest_steps")
    )


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_words: int = HELD_WORDS
) -> DataFrame:
    """One row per document with its log10 probability under the class model and under unigrams.

    Learns from documents whose id has a crc32 with another remainder modulo 10
    than 0; a null id counts as an empty text. Null and empty texts are one end
    token. Repeated rows count as often as they are there. With nothing to learn
    from, all words are unknown. Only the two named columns are read. An empty
    table gives an empty result.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.
    """
    rows = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text")
    )
    rows = rows.select("doc_id", (remainder(F.col("doc_id"), FOLDS) != 0).alias("train"), "text")
    counts = word_counts(rows.filter("train").select("text"))
    held = held_of(counts, held_words)
    texts = stored(coded(rows, list(held)), "coded-texts")
    model, others = learned(texts.filter("train"), counts, held)
    numbered = _partial(texts.drop("train"), model).withColumn("row", F.monotonically_increasing_id())
    partial = stored(numbered, "partial-scores")

    # the same count and the same addition in both models, so one sum serves both
    rest = _rest(partial, others, model)
    inner = F.col("inner") + F.coalesce("rest", F.lit(0.0))
    scored = partial.drop("others", "places", "lefts", "rights").join(rest, "row", "left").select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (inner - F.col("n_tokens") * F.lit(model.base_below)).alias("base_score"),
        (inner + F.col("steps") + F.coalesce("rest_steps", F.lit(0.0))).alias("score"),
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
