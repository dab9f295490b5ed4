"""Heads of words by the best projective tree of each sentence.

Which words go together is read from the corpus: how often two kinds of words stand
near each other in a sentence, against how often chance would put them there. The
tree of a sentence is the one whose links add up to the most, found by building
spans from shorter spans. Sentences of equal length are built side by side in numpy,
long ones one after another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.functions import tokens as tokenfns
from lexiframe.operators.linguistics import TOKENS
from lexiframe.operators.tagger import TAGS, kind_numbers, kinds

#: Words that stand at most so far apart are counted as neighbours.
NEAR = 5
#: None: a sentence is parsed as a whole, whatever its length. A number: a longer one is parsed in stretches
#: of so many words, whose roots hang on the first one's. No query sets it.
LONGEST: int | None = None
#: The span tables of sentences up to so many words are filled whole; those of longer ones up to a width that
#: is shown to be enough, first of all BAND. So many words are looked at together.
SHORT, BAND, FLAT_WORDS = 48, 80, 1 << 12
#: Sums that differ by no more may be equal.
CLOSE = 1e-6
#: What one more word between head and dependent costs, and what a fitting class of the head is worth.
DISTANCE_COST, FIT_WORTH = 0.3, 2.0
ADDED = 0.5
#: Classes of heads by the class of the dependent; others hang on verbs.
HEADS = {
    "DET": ("NOUN",),
    "ADJ": ("NOUN",),
    "NUM": ("NOUN",),
    "ADP": ("VERB", "NOUN"),
    "ADV": ("VERB", "ADJ"),
    "PART": ("VERB",),
    "AUX": ("VERB",),
}
#: Classes that make a root, best first.
ROOTS = ("VERB", "AUX", "NOUN")
#: Cells of span tables that are filled together; so many stay in a core's cache.
MOST_CELLS = 1 << 17


def near_counts(docs: DataFrame, tokens: str = TOKENS) -> DataFrame:
    """(left, right, n): how often a kind stands up to NEAR words before another in a sentence; a table of fixed size."""
    size = len(kinds())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            flat, sentence = _numbered(batch.column(0), batch.column(1))
            for gap in range(1, NEAR + 1):
                same = sentence[gap:] == sentence[:-gap]
                total += np.bincount(flat[:-gap][same].astype(np.int64) * size + flat[gap:][same], minlength=size * size)
        there = np.flatnonzero(total)
        columns = [pa.array((there // size).astype(np.int32)), pa.array((there % size).astype(np.int32)), pa.array(total[there])]
        yield pa.RecordBatch.from_arrays(columns, ["left", "right", "n"])

    pairs = docs.select(F.col(tokens)["text"].alias("texts"), F.col(tokens)["sent_id"].alias("sents"))
    summed = pairs.mapInArrow(count, "left int, right int, n long").groupBy("left", "right")
    return summed.agg(F.sum("n").alias("n"))


def association(docs: DataFrame, tokens: str = TOKENS) -> np.ndarray:
    """Pointwise mutual information of (left kind, right kind), from counts over all documents; unseen pairs get 0."""
    found = near_counts(docs, tokens).toArrow()  # at most kinds squared rows
    counts = np.zeros((len(kinds()),) * 2)
    counts[found["left"].to_numpy(), found["right"].to_numpy()] = found["n"].to_numpy()
    return mutual_information(counts)


def mutual_information(counts: np.ndarray) -> np.ndarray:
    total = counts.sum()
    if not total:
        return np.zeros(counts.shape, np.float32)
    chance = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        told = np.log((counts + ADDED) / (chance + ADDED))
    return np.where(counts > 0, told, 0).astype(np.float32)


def _numbered(texts: pa.ListArray, sents: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of all tokens of a batch, and a number for the sentence of each."""
    flat = kind_numbers(texts.flatten())
    number = sents.flatten().to_numpy(zero_copy_only=False)
    sizes = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return flat, np.cumsum((np.diff(number, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))


# -- trees -----------------------------------------------------------------


def arc_scores(table: np.ndarray, kinds_: np.ndarray, tags: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(ahead, back, roots) of sentences x words: what a link is worth, and a word as root, as ``span_trees`` takes them."""
    kinds_, tags = np.ascontiguousarray(kinds_.T), np.ascontiguousarray(tags.T)
    n = len(kinds_)
    fits = FIT_WORTH * _fits()
    ahead, back = [], []
    for gap in range(n):
        early, late = slice(0, n - gap), slice(gap, n)
        pair = table[kinds_[early], kinds_[late]] - np.float64(DISTANCE_COST * gap)
        ahead.append(pair + fits[tags[late], tags[early]])
        back.append(pair + fits[tags[early], tags[late]])
    return ahead, back, _root_worth()[tags]


def _fits() -> np.ndarray:
    """dependent class x head class -> 1 where they fit."""
    out = np.zeros((len(TAGS), len(TAGS)))
    for k, tag in enumerate(TAGS):
        for head in HEADS.get(tag, ("VERB",)):
            out[k, TAGS.index(head)] = 1
    return out


def _root_worth() -> np.ndarray:
    out = np.zeros(len(TAGS))
    for k, tag in enumerate(reversed(ROOTS)):
        out[TAGS.index(tag)] = FIT_WORTH * (k + 1)
    return out


def best_trees(arcs: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The head of every word (its own place for the root) in the best projective tree of each sentence.

    ``arcs`` is sentences x heads x dependents, ``roots`` sentences x words. See ``span_trees``.
    """
    n = roots.shape[1]
    ahead = [np.stack([arcs[:, i, i + gap] for i in range(n - gap)]) for gap in range(n)]
    back = [np.stack([arcs[:, i + gap, i] for i in range(n - gap)]) for gap in range(n)]
    return span_trees(ahead, back, np.ascontiguousarray(roots.T))


def _best_split(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(value, number) of the best of the sums of two arrays each; of equal ones the earliest."""
    best = parts[0][0] + parts[0][1]
    number = np.zeros(best.shape, np.int16)
    value, better = np.empty_like(best), np.empty(best.shape, bool)
    for k, (a, b) in enumerate(parts[1:], 1):
        np.add(a, b, out=value)
        np.greater(value, best, out=better)
        np.maximum(best, value, out=best)
        np.putmask(number, better, k)
    return best, number


def span_trees(ahead: list[np.ndarray], back: list[np.ndarray], roots: np.ndarray) -> np.ndarray:
    """The heads in the best projective tree of each of several sentences of equal length.

    ``ahead[gap][i]`` is what links from word i to the word ``gap`` later are worth, ``back[gap][i]``
    links the other way, ``roots[i]`` the word as root, each one number per sentence. Spans are open
    (their ends are about to be linked) or closed (one end has all its dependents in them);
    wider ones come from two narrower ones. Spans of one width lie side by side, so that each
    split is a sum of two slices. Of equal trees the earliest split stays.
    """
    n, sentences = roots.shape
    every = np.arange(sentences)[:, None]
    # [width][left end]; *_l: the head is the right end, *_r: the head is the left end
    shut_l, shut_r, open_l, open_r = ([np.zeros((n, sentences))] for _ in range(4))
    # [width, left end]
    cut_open = np.zeros((n, n, sentences), np.int16)
    cut_l, cut_r = cut_open.copy(), cut_open.copy()
    for width in range(1, n):
        m = n - width  # spans of this width
        splits = [(k, width - 1 - k) for k in range(width)]  # widths to the left and to the right of a gap between words
        value, cut_open[width, :m] = _best_split([(shut_r[k][:m], shut_l[r][k + 1 : k + 1 + m]) for k, r in splits])
        open_l.append(value + back[width])
        open_r.append(value + ahead[width])
        value, cut_l[width, :m] = _best_split([(shut_l[k][:m], open_l[width - k][k : k + m]) for k in range(width)])
        shut_l.append(value)
        value, cut_r[width, :m] = _best_split([(open_r[k + 1][:m], shut_r[r][k + 1 : k + 1 + m]) for k, r in splits])
        shut_r.append(value)
    places = np.arange(n)
    whole = [roots[k] + shut_l[k][0] + shut_r[n - 1 - k][k] for k in range(n)]
    root = np.stack(whole, axis=1).argmax(1)
    heads = np.tile(places, (sentences, 1))

    # spans still to be taken apart, of all sentences at once: kind 0 closed to the left, 1 closed to the right, 2 open
    s = np.concatenate([every[:, 0]] * 2)
    kind = np.repeat([0, 1], sentences)
    a = np.concatenate([np.zeros(sentences, np.int64), root])
    b = np.concatenate([root, np.full(sentences, n - 1)])
    while len(s):
        real = a < b
        s, kind, a, b = s[real], kind[real], a[real], b[real]
        to_left, to_right, opened = kind == 0, kind == 1, kind >= 2
        k = np.where(to_left, cut_l[b - a, a, s], np.where(to_right, cut_r[b - a, a, s], cut_open[b - a, a, s])).astype(np.int64)
        # links are made where a closed span opens
        l, r = to_left, to_right
        heads[s[l], a[l] + k[l]] = b[l]
        heads[s[r], a[r] + k[r] + 1] = a[r]
        s, kind, a, b = (
            np.concatenate(parts)
            for parts in zip(
                (s[l], np.zeros(l.sum(), np.int64), a[l], a[l] + k[l]),
                (s[l], np.full(l.sum(), 2), a[l] + k[l], b[l]),
                (s[r], np.full(r.sum(), 2), a[r], a[r] + k[r] + 1),
                (s[r], np.ones(r.sum(), np.int64), a[r] + k[r] + 1, b[r]),
                (s[opened], np.ones(opened.sum(), np.int64), a[opened], a[opened] + k[opened]),
                (s[opened], np.zeros(opened.sum(), np.int64), a[opened] + k[opened] + 1, b[opened]),
            )
        )
    return heads


def _spans(table: np.ndarray, kinds_: np.ndarray, tags: np.ndarray, owner: np.ndarray, band: int):
    """Span tables up to a width of ``band`` over sentences that lie one after another; ``owner`` numbers them.

    Gives ((shut_l, shut_r, open_l, open_r), useful, enough). The tables are [width, left end] as in ``span_trees``,
    spans across sentences are worth -inf. ``useful``: a link longer than that is worth less than closed spans without it.
    ``enough``: that is so for links of any length, see ``long_trees``.
    """
    n = len(kinds_)
    fits = FIT_WORTH * _fits()
    shut_l, shut_r, open_l, open_r = (np.full((band + 1, n), -np.inf) for _ in range(4))
    shut_l[0] = shut_r[0] = 0
    useful = 1
    turned, apart = np.zeros(band + 1), np.full(band + 1, -np.inf)
    for width in range(1, band + 1):
        m = n - width
        inside = owner[:m] == owner[width:]
        if not inside.any():
            break
        early, late = slice(0, m), slice(width, n)
        pair = table[kinds_[early], kinds_[late]] - np.float64(DISTANCE_COST * width)
        value, other = np.full(m, -np.inf), np.empty(m)
        for k in range(width):
            np.add(shut_r[k, :m], shut_l[width - 1 - k, k + 1 : k + 1 + m], out=other)
            np.maximum(value, other, out=value)
        value[~inside] = -np.inf
        open_l[width, :m] = value + (pair + fits[tags[early], tags[late]])
        open_r[width, :m] = value + (pair + fits[tags[late], tags[early]])
        left, right = np.full(m, -np.inf), np.full(m, -np.inf)
        for k in range(1, width):
            np.add(shut_l[k, :m], open_l[width - k, k : k + m], out=other)
            np.maximum(left, other, out=left)
            np.add(open_r[k, :m], shut_r[width - k, k : k + m], out=other)
            np.maximum(right, other, out=right)
        if ((open_l[width, :m] >= left - CLOSE) | (open_r[width, :m] >= right - CLOSE))[inside].any():
            useful = width
        np.maximum(left, open_l[width, :m], out=shut_l[width, :m])
        np.maximum(right, open_r[width, :m], out=shut_r[width, :m])
        l, r = shut_l[width, :m][inside], shut_r[width, :m][inside]
        turned[width] = np.abs(l - r).max()
        apart[width] = (value[inside] - np.minimum(l, r)).max()
    else:
        most = float(table.max()) + FIT_WORTH
        return (shut_l, shut_r, open_l, open_r), useful, _enough(turned, apart, useful, most, band)
    return (shut_l, shut_r, open_l, open_r), useful, True  # no sentence is wider


def _enough(turned: np.ndarray, apart: np.ndarray, useful: int, most: float, band: int) -> bool:
    """Whether no link longer than ``band`` can be of use; the reasons are in ``long_trees``."""
    for piece in range(1, band - useful + 1):
        if turned[piece : piece + useful].max() < DISTANCE_COST * piece - CLOSE:
            widths = np.arange(max(1, band + 2 - piece - useful), band + 1)
            return bool((apart[widths] - DISTANCE_COST * widths).max() + most < -CLOSE)
    return False


def _ends(shut: list[np.ndarray], useful: int, starts: np.ndarray, lengths: np.ndarray):
    """(value, cut) of the closed spans from each word to the first and to the last word of its sentence.

    ``cut`` is the word next on the way there. Links are at most ``useful`` long.
    """
    open_l, open_r = shut
    n = int(lengths.sum())
    to_first, to_last = np.zeros(n), np.zeros(n)
    cut_l, cut_r = np.arange(n), np.arange(n)
    gaps = np.arange(useful, 0, -1)  # the earliest split comes first
    order = np.argsort(-lengths, kind="stable")
    at_least = np.searchsorted(-lengths[order], -np.arange(int(lengths.max()) + 1), "right")
    for t in range(1, int(lengths.max())):
        mine = order[: at_least[t + 1]]
        j = starts[mine] + t
        k = j[:, None] - gaps[None, max(0, useful - t) :]
        ways = to_first[k] + open_l[j[:, None] - k, k]
        best = ways.argmax(1)
        rows = np.arange(len(mine))
        to_first[j], cut_l[j] = ways[rows, best], k[rows, best]
        i = starts[mine] + lengths[mine] - 1 - t
        k = i[:, None] + gaps[None, ::-1][:, : min(useful, t)]
        ways = open_r[k - i[:, None], i[:, None]] + to_last[k]
        best = ways.argmax(1)
        to_last[i], cut_r[i] = ways[rows, best], k[rows, best]
    return to_first, to_last, cut_l, cut_r


def long_trees(table: np.ndarray, kinds_: np.ndarray, tags: np.ndarray, lengths: np.ndarray, band: int | None = None) -> np.ndarray:
    """For sentences that lie one after another the place of each word's head, as in the trees of ``span_trees``.

    Spans are filled up to a width of ``band`` words. That gives the best trees if no longer link can be of use;
    if this does not show, the band doubles, until spans are as wide as the sentences. Time and memory grow with
    words times band.

    R(i, j) and L(i, j) are the best closed spans whose head is the left and the right end. Be all links longer
    than u, up to the band's width, worth less than closed spans without them. Take an innermost link from h to d,
    h < d, longer than the band; it joins R(h, k) and L(k + 1, d), whose links are at most u long. It is of
    no use if it is worth less than R(h, d), that is if A(h, d) = R(h, k) + L(k + 1, d) - R(h, d) and what the link
    is worth are below 0. L(k + 1, d) = L(k + 1, y) + L(y, d) for some y of every u words, and
    R(h, d) >= R(h, y) + R(y, d), so A(h, d) <= A(h, y) + L(y, d) - R(y, d). Likewise A(h, d) <= A(x, d)
    where R(h, k) = R(h, x) + R(x, k). Where |L - R| of any p to p + u - 1 words (``turned``) is less than their distance
    costs, A less the distance cost therefore does not grow from the last p + u - 2 widths of the band (``apart``) on; if
    there the dearest link is not worth it, no longer one is. Links the other way are the mirror image.
    """
    n = len(kinds_)
    longest = int(lengths.max())
    band = min(band or BAND, longest - 1)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(lengths)), lengths)
    tables, useful, enough = _spans(table, kinds_, tags, owner, band)
    if not enough and band < longest - 1:
        if len(lengths) == 1:
            return long_trees(table, kinds_, tags, lengths, 2 * band)
        del tables
        parts = [long_trees(table, kinds_[a:b], tags[a:b], lengths[k : k + 1], band) + a for k, (a, b) in enumerate(zip(starts, ends))]
        return np.concatenate(parts)
    shut_l, shut_r, open_l, open_r = tables
    to_first, to_last, cut_l, cut_r = _ends([open_l, open_r], useful, starts, lengths)
    worth = _root_worth()[tags] + to_first + to_last
    root = np.array([a + worth[a:b].argmax() for a, b in zip(starts, ends)])
    heads = np.arange(n)
    # spans still to be taken apart: kind 0 closed to the left, 1 closed to the right, 2 open
    found = []
    for cut, stop in ((cut_l, starts), (cut_r, ends - 1)):
        now = root[root != stop]
        last = stop[root != stop]
        while len(now):
            to = cut[now]
            heads[to] = now
            found.append((np.minimum(now, to), np.maximum(now, to)))
            now, last = to[to != last], last[to != last]
    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    kind = np.full(len(a), 2)
    while len(a):
        k = np.empty(len(a), np.int64)
        for of, (first, second) in enumerate(((shut_l, open_l), (open_r, shut_r), (shut_r, shut_l))):
            mine = np.flatnonzero(kind == of)
            if len(mine):
                k[mine] = _cuts(of, first, second, a[mine], b[mine])
        l, r, opened = kind == 0, kind == 1, kind == 2
        heads[k[l]] = b[l]
        heads[k[r]] = a[r]
        parts = (
            (0, a[l], k[l]),
            (2, k[l], b[l]),
            (2, a[r], k[r]),
            (1, k[r], b[r]),
            (1, a[opened], k[opened]),
            (0, k[opened] + 1, b[opened]),
        )
        kind = np.concatenate([np.full(len(x), of) for of, x, _ in parts])
        a, b = (np.concatenate([p[side] for p in parts]) for side in (1, 2))
        real = a < b
        kind, a, b = kind[real], a[real], b[real]
    return heads


def _cuts(kind: int, first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The word at which each span of a kind is best cut; of equal cuts the earliest."""
    out = np.empty(len(a), np.int64)
    order = np.argsort(b - a, kind="stable")
    for at in range(0, len(order), 1024):  # spans of like widths
        some = order[at : at + 1024]
        i, width = a[some, None], (b - a)[some, None]
        step = np.arange(int(width.max()))[None]
        there = step < width
        step = np.where(there, step, 0)
        if kind == 0:
            ways = first[step, i] + second[width - step, i + step]
        elif kind == 1:
            ways = first[step + 1, i] + second[width - 1 - step, i + step + 1]
        else:
            ways = first[step, i] + second[width - 1 - step, i + step + 1]
        out[some] = a[some] + np.where(there, ways, -np.inf).argmax(1) + (kind == 1)
    return out


def sentence_heads(table: np.ndarray, kinds_: np.ndarray, tags: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For a flat array of tokens the place of each one's head; a root is its own."""
    if LONGEST is not None:
        return _heads_by_stretches(table, kinds_, tags, starts, lengths)
    heads = np.arange(len(kinds_))
    _short_heads(heads, table, kinds_, tags, starts[lengths <= SHORT], lengths[lengths <= SHORT])
    long = np.flatnonzero(lengths > SHORT)
    long = long[np.argsort(lengths[long], kind="stable")]
    part = (np.cumsum(lengths[long]) - 1) // FLAT_WORDS
    for some in np.split(long, np.flatnonzero(np.diff(part)) + 1) if len(long) else ():
        size = lengths[some]
        places = np.arange(size.sum()) + np.repeat(starts[some] - (np.cumsum(size) - size), size)
        heads[places] = places[long_trees(table, kinds_[places], tags[places], size)]
    return heads


def _short_heads(heads: np.ndarray, table: np.ndarray, kinds_: np.ndarray, tags: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Put the heads of sentences in their places, those of equal length side by side."""
    for n in np.unique(size):
        group = np.flatnonzero(size == n)
        side = max(1, MOST_CELLS // int(n) ** 2)
        for at in range(0, len(group), side):
            places = begin[group[at : at + side], None] + np.arange(n)
            found = span_trees(*arc_scores(table, kinds_[places], tags[places]))
            heads[places] = places[:, :1] + found


def _heads_by_stretches(table: np.ndarray, kinds_: np.ndarray, tags: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    heads = np.arange(len(kinds_))
    pieces = -(-lengths // LONGEST)
    owner = np.repeat(np.arange(len(starts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[owner] + number * LONGEST
    size = np.minimum(lengths[owner] - number * LONGEST, LONGEST)
    _short_heads(heads, table, kinds_, tags, begin, size)
    later = np.flatnonzero(number)
    if len(later):
        is_root = heads == np.arange(len(heads))
        root_of = np.zeros(len(owner), np.int64)
        which = np.searchsorted(begin, np.flatnonzero(is_root), "right") - 1
        root_of[which] = np.flatnonzero(is_root)
        heads[root_of[later]] = root_of[later - number[later]]
    return heads


# -- over tables -----------------------------------------------------------


def with_heads(docs: DataFrame, table: np.ndarray, tokens: str = TOKENS, fields: Sequence[str] = tokenfns.ANNOTATIONS) -> DataFrame:
    """Add ``dep`` and ``head_tok_id`` to every token struct (annotated ones, with ``pos``) by the best tree of its sentence.

    Links are labelled by the dependent's class and side. No shuffle: a document's sentences are
    parsed in its row. A null token array gets null, all other columns pass through. ``fields`` names the
    annotations that the structs have.
    """
    own = F.col(tokens)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # kinds squared numbers

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def parse(texts: pa.Array, sents: pa.Array, tags: pa.Array) -> pa.Array:
        other = TAGS.index("SYM")
        flat, sentence = _numbered(texts, sents)
        coded = tags.flatten().dictionary_encode()
        known = [TAGS.index(t) if t in TAGS else other for t in coded.dictionary.to_pylist()]
        classes = np.array(known, np.int64)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        starts = np.flatnonzero(np.diff(sentence, prepend=-1))
        heads = sentence_heads(shared.value, flat, classes, starts, np.diff(np.append(starts, len(flat))))
        sizes = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        heads = (heads - np.repeat(ends[:-1], sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(heads), mask=texts.is_null())

    # token structs stay in the JVM; as a column that may differ it is computed once
    parsed = docs.withColumn("__heads", parse.asNondeterministic()(own["text"], own["sent_id"], own["pos"]))
    return parsed.withColumn(tokens, tokenfns.with_links(own, F.col("__heads"), fields)).drop("__heads")
