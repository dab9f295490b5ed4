"""Quality classifier: a convolutional network over the bytes of whole documents, in numpy.

A byte window of six bytes is mapped by learned byte vectors and sixteen learned
filters. Filters are max-pooled inside overlapping chunks that cover the document;
a document is the maximum and the mean over its chunks, combined by one logistic
unit. A long document is more chunks, never a cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes a filter sees, filters, numbers per byte.
SPAN, FILTERS, WIDTH = 6, 16, 8
#: Chunks are two halves long and start at every half.
HALF = 256
#: Bound on the fitting sample: rows of each class, and bytes of a text in it.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 32_768
EPOCHS, BATCH, RATE, DECAY = 6, 16, 0.01, 1e-4
#: Window positions that are evaluated together.
SLICE = 65_536


@dataclass
class Model:
    vectors: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # SPAN x WIDTH x FILTERS
    bias: np.ndarray  # FILTERS
    heads: np.ndarray  # 2 x FILTERS: of maximum and of mean
    base: float

    def parts(self):
        return [self.vectors, self.filters, self.bias, self.heads]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by SPAN - 1 zero bytes.

    Returns the bytes, where the windows of each half begin and end, and the
    document of each half. An empty text has no halves.
    """
    pad = b"\0" * (SPAN - 1)
    joined = np.frombuffer(pad.join(texts) + pad, np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths + SPAN - 1) - lengths - SPAN + 1
    halves = -(-lengths // HALF)
    doc = np.repeat(np.arange(len(texts)), halves)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(halves) - halves, halves)
    first = np.repeat(begins, halves) + inner * HALF
    return joined, first, np.minimum(first + HALF, np.repeat(begins + lengths, halves)), doc


def pool(best: np.ndarray, doc: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half maxima to (chunk maxima, document of each chunk, half that a chunk starts at)."""
    last = np.concatenate((doc[1:] != doc[:-1], [True])) if len(doc) else np.zeros(0, bool)
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else last
    start = np.flatnonzero(~last | first)  # a document of one half is one chunk
    second = np.where(last[start], start, start + 1)
    return np.maximum(best[start], best[second]), doc[start], start


def features(best: np.ndarray, doc: np.ndarray, documents: int) -> np.ndarray:
    """documents x 2 x FILTERS: maximum and mean over the chunks; zeros for an empty text."""
    chunks, owner, _ = pool(best, doc, documents)
    out = np.zeros((documents, 2, best.shape[1]), np.float32)
    np.maximum.at(out[:, 0], owner, chunks)
    np.add.at(out[:, 1], owner, chunks)
    out[:, 1] /= np.maximum(np.bincount(owner, minlength=documents), 1)[:, None]
    return out


def _windows(joined: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(joined, SPAN)


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Model:
    """Adam on the log loss; gradients flow through the window that won each half."""
    rng = np.random.default_rng(seed)
    ones = sum(labels)
    model = Model(
        rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
        rng.normal(0, 0.3, (SPAN, WIDTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, (2, FILTERS)).astype(np.float32),
        0.0,
    )
    if not 0 < ones < len(labels):  # nothing to tell apart: the smoothed share of label 1
        model.heads[:] = 0
        model.base = float(np.log((ones + 1) / (len(labels) - ones + 1)))
        return model
    target = np.array(labels, np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()] + [(np.zeros(1), np.zeros(1))]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            joined, begins, ends, doc = layout([texts[k] for k in chosen])
            if not len(begins):
                continue
            view = _windows(joined)
            flat = model.filters.reshape(SPAN * WIDTH, FILTERS)
            best = np.zeros((len(begins), FILTERS), np.float32)
            won = np.zeros((len(begins), FILTERS), np.int64)
            for k, (a, b) in enumerate(zip(begins, ends)):  # halves are short: one small product each
                got = model.vectors[view[a:b]].reshape(b - a, -1) @ flat
                won[k] = a + got.argmax(0)
                best[k] = got.max(0)
            best += model.bias
            active = best > 0
            best = np.maximum(best, 0)
            documents = len(chosen)
            feats = features(best, doc, documents)
            logit = (feats * model.heads).sum((1, 2)) + model.base
            error = (1 / (1 + np.exp(-logit)) - target[chosen]) / documents
            grad_heads = (error[:, None, None] * feats).sum(0)
            chunks, owner, start = pool(best, doc, documents)
            per = np.maximum(np.bincount(owner, minlength=documents), 1)
            # to the halves: all of a document's chunks through the mean, its best chunk through the maximum
            to_chunk = (error / per)[owner][:, None] * model.heads[1]
            top = np.zeros((documents, FILTERS), np.int64)
            for d in np.unique(owner):
                mine = np.flatnonzero(owner == d)
                top[d] = mine[chunks[mine].argmax(0)]
            there = np.unique(owner)
            np.add.at(to_chunk, (top[there], np.arange(FILTERS)), error[there][:, None] * model.heads[0])
            second = np.minimum(start + 1, len(doc) - 1)
            second = np.where(doc[second] == owner, second, start)
            half = np.where(best[start] >= best[second], start[:, None], second[:, None])
            to_half = np.zeros_like(best)
            np.add.at(to_half, (half, np.arange(FILTERS)), to_chunk)
            to_half *= active
            grad_bias = to_half.sum(0)
            seen = view[won]  # halves x FILTERS x SPAN
            grad_filters = np.einsum("hf,hfsw->swf", to_half, model.vectors[seen])
            grad_vectors = np.zeros_like(model.vectors)
            np.add.at(grad_vectors, seen, to_half[:, :, None, None] * model.filters.transpose(2, 0, 1)[None])
            step += 1
            grads = [grad_vectors, grad_filters, grad_bias, grad_heads]
            for part, grad, (m, v) in zip(model.parts(), grads, moments):
                part -= _adam(grad + DECAY * part, m, v, step)
            model.base -= float(_adam(np.array([error.sum()]), *moments[-1], step)[0])
    return model


def _adam(grad: np.ndarray, m: np.ndarray, v: np.ndarray, step: int) -> np.ndarray:
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    return RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def pair_tables(model: Model) -> list[np.ndarray]:
    """What each pair of bytes adds to every filter, for the three pairs of a window."""
    one = np.einsum("bw,swf->sbf", model.vectors, model.filters).astype(np.float32)
    tables = [(one[s][:, None, :] + one[s + 1][None, :, :]).reshape(65_536, FILTERS) for s in range(0, SPAN, 2)]
    tables[0] += model.bias
    return tables


def score(texts: list[bytes], model: Model, tables: list[np.ndarray]) -> np.ndarray:
    """Probability of label 1 for whole texts."""
    joined, begins, ends, doc = layout(texts)
    best = np.zeros((len(begins), FILTERS), np.float32)
    if len(begins):
        pairs = joined[:-1].astype(np.uint16) << 8 | joined[1:]
        positions = len(joined) - SPAN + 1
        cut = np.searchsorted(begins, np.arange(0, positions, SLICE))
        for a, b in zip(cut, np.append(cut[1:], len(begins))):
            if a == b:
                continue
            low, high = begins[a], ends[a:b].max()
            got = tables[0].take(pairs[low:high], axis=0)
            for k in range(1, SPAN // 2):
                got += tables[k].take(pairs[low + 2 * k : high + 2 * k], axis=0)
            # every other stretch lies between two halves and is passed over
            marks = np.empty(2 * (b - a), np.int64)
            marks[0::2], marks[1::2] = begins[a:b] - low, ends[a:b] - low
            if marks[-1] == high - low:
                marks = marks[:-1]
            best[a:b] = np.maximum.reduceat(got, marks, axis=0)[0::2]
    feats = features(np.maximum(best, 0), doc, len(texts))
    logit = (feats * model.heads).sum((1, 2)).astype(np.float64) + model.base
    return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit on at most ``sample_rows`` labelled documents of each class, each at most ``sample_bytes`` long.

    Rows with remainder 1 modulo 3 are held out. Those with the smallest hashes of
    their ids are taken, so the sample does not depend on the files' order. Labels
    that are null or without a document are passed over.
    """
    usable = labels.filter(remainder(labels[id_col], 3) != 1).select(
        labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("label")
    )
    short = docs.select(docs[id_col].alias("label_id"), docs[text_col].cast("binary").alias("text")).filter(
        F.octet_length("text").between(1, sample_bytes)
    )
    picked = None
    for label in (0, 1):
        order = F.md5(F.col("label_id").cast("string"))
        few = usable.filter(F.col("label") == label).orderBy(order, "label_id").limit(sample_rows)
        picked = few if picked is None else picked.unionByName(few)
    # at most two classes of sample_rows ids
    rows = short.join(F.broadcast(picked), "label_id").select("label_id", "label", "text").limit(4 * sample_rows).collect()
    rows.sort(key=lambda r: (str(r.label_id), r.label, bytes(r.text)))
    return train([bytes(r.text) for r in rows], [r.label for r in rows])


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text's bytes enter a score, so equal texts score equal. Null and
    empty texts get the score of a text without evidence. Without usable labels of
    both classes every score is the smoothed share of label 1. Only the named
    columns are read. An empty table gives an empty result.
    """
    model = model or fit(docs, labels, id_col, text_col)
    scored = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    return with_score(scored, model).select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None
) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    Null and empty texts are judged as texts without evidence, repeated rows alike. An
    empty table gives an empty result. See ``quality_scores``.
    """
    model = model or fit(docs, labels, id_col, text_col)
    names = docs.columns
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    text = F.coalesce(rows[names.index(text_col)], F.lit("")).cast("binary")
    return with_score(rows.withColumn("text", text), model).filter("score >= 0.5").drop("score").toDF(*names)


def with_score(rows: DataFrame, model: Model) -> DataFrame:
    """Replace the last column, the text's bytes, by its score; others pass through."""
    kept = rows.schema.fields[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = pair_tables(model)
        for batch in batches:
            texts = [bytes(t) for t in batch.column(len(kept)).to_pylist()]
            scores = score(texts, model, tables) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*(f.name for f in kept), "score"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
