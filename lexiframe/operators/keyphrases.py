"""Word importance, word graphs, PageRank and key phrases per document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lexiframe.functions import linguistics as L
from lexiframe.functions import phrases as P
from lexiframe.functions.columns import let, unnest
from lexiframe.functions.vectors import cosine
from lexiframe.operators.linguistics import TOKENS, WORDS_COLUMN
from lexiframe.session import scratch_path

# PageRank damping, tolerance per node and round limit.
DAMPING = 0.85
TOLERANCE = 1e-6
MAX_ROUNDS = 100
# rows of one Arrow batch on the way back
ROWS = 1 << 16


def with_words(docs: DataFrame) -> DataFrame:
    """Add ``vocab`` (distinct content words with counts and positions) from the token array."""
    return docs.withColumn("vocab", P.vocabulary(L.content(F.col(TOKENS))["lower"]))


def candidate_phrases(docs: DataFrame, doc_id: str) -> DataFrame:
    found = P.candidate_phrases(F.col(TOKENS))
    rows = docs.select(doc_id, F.posexplode_outer(found).alias("phrase_idx", "p"))
    return rows.filter("phrase_idx is not null").select(doc_id, "phrase_idx", "p.phrase")


def word_importance(docs: DataFrame, doc_id: str) -> DataFrame:
    return unnest(with_words(docs), [doc_id], P.word_importance(F.col("vocab")), "word")


def content_words(docs: DataFrame) -> Column:
    """The lower-cased content words of each document: a column of their own, or those of the token array."""
    return F.col(WORDS_COLUMN) if WORDS_COLUMN in docs.columns else L.content(F.col(TOKENS))["lower"]


def _numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a batch of word lists: each word's document, its number, and the words in the order of their numbers."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()  # by bytes, as Spark sorts
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    words = number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), words, coded.dictionary.take(pa.array(order))


def _neighbours(doc: np.ndarray, word: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at most ``window`` apart in one document."""
    pairs = [np.zeros((2, 0), np.int64)]
    for step in range(1, min(window, len(word) - 1) + 1):
        at = np.flatnonzero(doc[:-step] == doc[step:])
        pairs.append(np.stack([at, at + step]))
    return tuple(np.concatenate(pairs, axis=1))


def _rows(names: Sequence[str], *columns: tuple[pa.Array, np.ndarray] | np.ndarray) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; a pair is values and where to take them from."""
    size = len(columns[0][1])
    for at in range(0, size, ROWS):
        cells = [c[0].take(pa.array(c[1][at : at + ROWS])) if isinstance(c, tuple) else pa.array(c[at : at + ROWS]) for c in columns]
        yield pa.RecordBatch.from_arrays(cells, names)


def cooccurrence_edges(docs: DataFrame, doc_id: str, window: int = P.WINDOW) -> DataFrame:
    """``(doc, src, dst)``: undirected, distinct links between words at most ``window`` content words apart.

    Made in numpy from Arrow batches of word lists: a link is one whole number, and one sort finds the distinct ones.
    """
    rows = docs.select(doc_id, content_words(docs).alias("words"))
    names = [doc_id, "src", "dst"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, word, words = _numbered(batch.column(1))
            a, b = _neighbours(doc, word, window)
            low, high = np.minimum(word[a], word[b]), np.maximum(word[a], word[b])
            code = np.unique((doc[a] * len(words) + low) * len(words) + high)
            first, high = np.divmod(code, max(len(words), 1))
            owner, low = np.divmod(first, max(len(words), 1))
            yield from _rows(names, (batch.column(0), owner), (words, low), (words, high))

    schema = StructType([rows.schema[0], StructField("src", StringType()), StructField("dst", StringType())])
    return rows.mapInArrow(run, schema)


def word_ids() -> Column:
    """The vocabulary index of the word at each content word position."""
    return P.spread(F.col("vocab"), lambda v, k: k)


def word_counts() -> Column:
    return P.spread(F.col("vocab"), lambda v, k: v["n"])


def _scores(doc: np.ndarray, node: np.ndarray, owner: np.ndarray, docs: int, window: int) -> np.ndarray:
    """PageRank per node of a batch of documents, which are one block-diagonal graph; 0 for a node without links.

    ``doc`` and ``node`` are given by position, ``owner`` is the document of each node. All documents advance together;
    one stops moving once its change falls below the tolerance, and its links are put aside when most have stopped.
    """
    nodes = len(owner)
    a, b = _neighbours(doc, node, window)
    code = np.unique(np.concatenate([node[a] * nodes + node[b], node[b] * nodes + node[a]]))
    src, dst = np.divmod(code, max(nodes, 1))
    degree = np.bincount(src, minlength=nodes).astype("float64")
    linked = degree > 0
    count = np.bincount(owner[linked], minlength=docs).astype("float64")
    share = np.where(linked, 1.0 / np.maximum(count[owner], 1), 0.0)
    result, score, live = share.copy(), share, count > 0
    kept, degree = np.arange(nodes), np.maximum(degree, 1)
    for _ in range(MAX_ROUNDS):
        flow = np.bincount(dst, (score / degree)[src], minlength=len(score))
        moved = DAMPING * flow + (1 - DAMPING) * share
        change = np.bincount(owner, np.abs(moved - score), minlength=docs)
        score = np.where(live[owner], moved, score)
        live &= change >= count * TOLERANCE
        if not live.any():
            break
        on = live[owner]
        if 4 * np.count_nonzero(on) <= 3 * len(on):
            result[kept] = score
            links = on[src]
            place = np.cumsum(on) - 1
            src, dst = place[src[links]], place[dst[links]]
            kept, owner, share, degree, score = kept[on], owner[on], share[on], degree[on], score[on]
    result[kept] = score
    return result


def pagerank_scores(
    ids: pd.Series, sizes: pd.Series | None = None, window: int = P.WINDOW
) -> pd.Series:
    """PageRank per vocabulary index for each document of a batch.

    A word without a link (a one-word document) gets no score.
    """
    sizes = ids.map(len) if sizes is None else sizes
    vocab = ids.map(lambda a: int(a.max()) + 1 if len(a) else 0).to_numpy()
    first = np.concatenate([[0], np.cumsum(vocab)]).astype("int64")
    doc = np.repeat(np.arange(len(ids)), sizes)
    node = np.concatenate([*ids, np.array([], dtype="int64")]).astype("int64") + first[doc]
    score = _scores(doc, node, np.repeat(np.arange(len(ids)), vocab), len(ids), window)
    return pd.Series([score[a:b] for a, b in zip(first[:-1], first[1:])])


def pagerank_column(ids: str) -> Column:
    """Scores in vocabulary order, from the column of word indexes by position.

    The graph of a document is a small local computation on numbers already in
    its row; running it on Arrow batches avoids a shuffle per round. Passing the
    size as well keeps ``ids`` a column of its own: the optimizer would
    otherwise fold its expression into the call, where Spark cannot split it off.
    """

    @F.pandas_udf("array<double>")
    def rank(batch: pd.Series, sizes: pd.Series) -> pd.Series:
        return pagerank_scores(batch, sizes)

    return rank.asNondeterministic()(F.col(ids), F.size(ids))


def pagerank(docs: DataFrame, doc_id: str) -> DataFrame:
    """``(doc, node, score)`` for every word that has a link."""
    rows = docs.select(doc_id, content_words(docs).alias("words"))
    names = [doc_id, "node", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, word, words = _numbered(batch.column(1))
            code, node = np.unique(doc * len(words) + word, return_inverse=True)
            owner, word = np.divmod(code, max(len(words), 1))
            score = _scores(doc, node, owner, batch.num_rows, P.WINDOW)
            on = score > 0
            yield from _rows(names, (batch.column(0), owner[on]), (words, word[on]), score[on])

    schema = StructType([rows.schema[0], StructField("node", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def with_phrase_scores(docs: DataFrame, mode: str) -> DataFrame:
    """Add ``phrases``: every candidate with similarity, importance and hybrid score.

    Similarity is the cosine between word counts of phrase and document. In
    column mode a word's importance is its count, in text mode its PageRank.
    """
    worded = (
        with_words(docs)
        .withColumn("counts", word_counts())
        .withColumn("found", P.candidate_phrases(F.col(TOKENS)))
    )
    if mode == "column":
        scores, top = F.col("counts"), P.max_count(F.col("vocab"))
    else:
        worded = worded.withColumn("ids", word_ids()).withColumn("rank", pagerank_column("ids"))
        scores = P.spread(F.col("vocab"), lambda v, k: F.get(F.col("rank"), k))
        best = F.array_max("rank")
        top = F.when(best > 0, best).otherwise(1.0)
    scored = P.score_phrases(F.col("found"), F.col("counts"), scores, top)
    return worded.withColumn("phrases", scored).select(*docs.columns, "phrases")


def hybrid_scores(docs: DataFrame, doc_id: str, mode: str) -> DataFrame:
    return unnest(with_phrase_scores(docs, mode), [doc_id], F.col("phrases"), "phrase_idx")


def keyphrases(
    docs: DataFrame, mode: str, name: str = "key_phrase", k: int | None = None
) -> DataFrame:
    """Add the phrases of each document, best first, as one string."""
    ranked = P.rank(F.col("phrases"), k)
    text = L.join_or(
        ranked["phrase"], L.SEPARATOR[mode], L.NO_KEYPHRASE[mode]
    )
    return with_phrase_scores(docs, mode).withColumn(name, text).drop("phrases")


def rank_phrases(scored: DataFrame, doc_id: str, mode: str, k: int | None = None) -> DataFrame:
    """The same string from a table ``(doc, phrase_idx, phrase, score)``, e.g. with own vectors."""
    group = F.collect_list(F.struct("phrase_idx", "phrase", "score"))
    ranked = P.rank(F.col("__p"), k)
    text = L.join_or(
        ranked["phrase"], L.SEPARATOR[mode], L.NO_KEYPHRASE[mode]
    )
    return scored.groupBy(doc_id).agg(group.alias("__p")).select(doc_id, text.alias("key_phrase"))


def similarity_join(
    left: DataFrame, right: DataFrame, on: list[str], left_vec: str, right_vec: str
) -> DataFrame:
    """Cosine of the vectors of rows that share ``on``, e.g. phrases with their document."""
    return left.join(right, on).withColumn("similarity", cosine(F.col(left_vec), F.col(right_vec)))


def embed(
    docs: DataFrame, dims: int = 1 << 10, out: str = "embedding", keep: Sequence[str] | None = None
) -> DataFrame:
    """Unit vectors of hashed, idf-weighted content words; all zeros without such words.

    One pass counts in how many documents each of the ``dims`` slots occurs, a table of
    that many numbers; the rest is per row. The columns to ``keep`` (all) and each row's slots
    are written once for both, so that tokens are not made twice.
    """
    keep = docs.columns if keep is None else keep

    def counted(words: Column) -> Column:
        """``array<struct<slot, n>>`` in slot order."""
        slot = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dims)))

        def runs(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
            ends = lambda a, k: F.coalesce(F.get(a, k + 1), F.size(s))
            found = let(at, lambda a: F.transform(a, lambda x, k: F.struct(F.get(s, x).alias("slot"), (ends(a, k) - x).alias("n"))))
            return F.when(F.size(s) > 0, found).otherwise(F.array().cast("array<struct<slot:bigint,n:int>>"))

        return let(F.sort_array(slot), runs)

    spark = docs.sparkSession
    made = docs.select(*keep, counted(L.content(F.col(TOKENS))["lower"]).alias("__e"))
    path = scratch_path(spark, "word-slots")
    made.write.parquet(path)
    entries = spark.read.schema(made.schema).parquet(path)
    seen = entries.select(F.explode("__e.slot").alias("slot")).groupBy("slot").agg(F.count("*").alias("df"))
    slots = spark.range(dims).withColumnRenamed("id", "slot").join(seen, "slot", "left")
    listed = slots.agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("df", F.lit(0)).alias("df")))).alias("__df"))
    total = entries.agg(F.count("*").alias("__n"))
    # one row of dims numbers
    joined = entries.join(F.broadcast(listed.join(total)))
    zeros = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda d: F.struct(d.alias("slot"), F.lit(0.0).alias("x")))
    weigh = lambda e: e["n"] * F.log((F.col("__n") + 1) / (F.get(F.col("__df"), e["slot"].cast("int"))["df"] + 1))
    weighted = F.transform("__e", lambda e: F.struct(e["slot"].alias("slot"), weigh(e).alias("x")))

    def dense(all_: Column) -> Column:
        """Of each slot the largest weight: the word's, or zero."""
        last = lambda v, i: F.coalesce(F.get(all_, i + 1)["slot"] != v["slot"], F.lit(True))
        return F.filter(all_, last)["x"]

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    vector = let(let(F.sort_array(F.concat(zeros, weighted)), dense), unit)
    return joined.withColumn(out, vector).drop("__e", "__df", "__n")
