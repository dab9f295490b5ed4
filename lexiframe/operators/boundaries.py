"""Sentence boundaries that are learned from the corpus.

A word is an abbreviation if it stands before a period far more often than chance,
weighted by how short it is and how seldom it stands without one. A word is a starter
if it follows the period of an ordinary word far more often than chance. Both come
from counts over all documents, as log-likelihood ratios. A period after an
abbreviation ends a sentence only before a starter; one inside a word or number never does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.columns import is_one_of, let
from lexiframe.functions.tokens import SENTENCE_PIECE

WORD = r"\p{L}+\.?"
#: Share of an abbreviation's occurrences that have a period, and the least score of one.
ALWAYS, ABBREVIATION_SCORE = 0.99, 0.3
#: Least ratio of a starter.
STARTER_SCORE = 30.0
#: Most words a model holds of each kind; of more, the highest scores.
MOST_WORDS = 20_000
DIGITS = 9


@dataclass
class Model:
    abbreviations: list[str]
    starters: list[str]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _bare(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(".")))


def _fit(k: Column, n: Column, p: Column) -> Column:
    """Log likelihood of k out of n at chance p; 0 ln 0 is 0."""
    part = lambda x, q: F.when(x == 0, 0.0).otherwise(x * F.log(q))
    return part(k, p) + part(n - k, 1 - p)


def _with_totals(counts: DataFrame) -> DataFrame:
    """Add the sums of n and hits over all words: a table of one row."""
    totals = counts.agg(F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"))
    return counts.crossJoin(F.broadcast(totals))  # one row


def abbreviations(docs: DataFrame, text: str) -> DataFrame:
    """(word, n, hits, score): words before a period, in lower case; ``hits`` of ``n`` have one. Only scores above 0.

    The score is twice the log likelihood ratio of a period almost always against a period as
    often as anywhere, times e to the minus length, over length to the power of the occurrences without period.
    """
    each = docs.select(F.explode(_words(F.col(text))).alias("w"))
    counts = each.groupBy(_bare(F.col("w")).alias("word")).agg(
        F.count("*").alias("n"), F.sum(F.col("w").endswith(".").cast("long")).alias("hits")
    )
    n, hits, chance = F.col("n"), F.col("hits"), F.col("all_hits") / F.col("all_n")
    size = F.length("word")
    ratio = 2 * (_fit(hits, n, F.lit(ALWAYS)) - _fit(hits, n, chance))
    score = F.round(ratio * F.exp(-size) * F.pow(size, hits - n), DIGITS)
    scored = _with_totals(counts).filter((F.col("hits") > 0) & (F.col("all_hits") < F.col("all_n"))).withColumn("score", score)
    return scored.filter("score > 0").select("word", "n", "hits", "score")


def starters(docs: DataFrame, text: str, known: list[str]) -> DataFrame:
    """(word, n, hits, score): words, in lower case, that follow the period of a word which is no abbreviation.

    ``hits`` of ``n`` occurrences do. The score is twice the log likelihood ratio of the word's own share
    against the share of all words, for words above that share.
    """

    def pairs(ws: Column) -> Column:
        def after_period(w: Column, i: Column) -> Column:
            before = F.get(ws, i - 1)
            ended = before.endswith(".") & ~is_one_of(_bare(before), known) if known else before.endswith(".")
            return F.struct(_bare(w).alias("word"), F.coalesce(ended & (i > 0), F.lit(False)).alias("hit"))

        return F.transform(ws, after_period)

    each = docs.select(F.explode(let(_words(F.col(text)), pairs)).alias("x")).select("x.*")
    counts = each.groupBy("word").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    n, hits, chance = F.col("n"), F.col("hits"), F.col("all_hits") / F.col("all_n")
    ratio = F.round(2 * (_fit(hits, n, hits / n) - _fit(hits, n, chance)), DIGITS)
    scored = _with_totals(counts).filter((hits / n > chance) & (F.col("all_hits") < F.col("all_n"))).withColumn("score", ratio)
    return scored.filter("score > 0").select("word", "n", "hits", "score")


def _listed(scored: DataFrame, least: float) -> list[str]:
    top = scored.filter(F.col("score") >= least).orderBy(F.desc("score"), "word").limit(MOST_WORDS)
    return sorted(r.word for r in top.select("word").collect())  # at most MOST_WORDS


def fit(docs: DataFrame, text: str) -> Model:
    """Learn from all texts; null and empty ones count for nothing."""
    known = _listed(abbreviations(docs, text), ABBREVIATION_SCORE)
    return Model(known, _listed(starters(docs, text, known), STARTER_SCORE))


def sentences(text: Column, model: Model) -> Column:
    """The sentences of a text, trimmed; stretches without a letter are left out. In the row, linear in the text."""

    def closes(pieces: Column, i: Column) -> Column:
        """Does a sentence end with this piece?"""
        piece, after = F.get(pieces, i), F.coalesce(F.get(pieces, i + 1), F.lit(""))
        period = piece.rlike(r"(^|[^.!?])\.$")
        inside = period & after.rlike(r"^[\p{L}\p{N}]")
        last = F.lower(F.regexp_extract(piece, r"(\p{L}+)\.$", 1))
        following = F.lower(F.regexp_extract(after, r"^\P{L}*(\p{L}+)", 1))
        held = period & (is_one_of(last, model.abbreviations) if model.abbreviations else F.lit(False))
        starts = is_one_of(following, model.starters) if model.starters else F.lit(False)
        return ~inside & (~held | starts)

    def joined(pieces: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i == 0) | closes(pieces, i - 1))
        return let(
            begins,
            lambda b: F.transform(
                b, lambda at, k: F.array_join(F.slice(pieces, at + 1, F.coalesce(F.get(b, k + 1), F.size(pieces)) - at), "")
            ),
        )

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE_PIECE), F.lit(0))
    none = F.array().cast("array<string>")
    whole = let(pieces, lambda p: F.when(F.size(p) > 0, joined(p)).otherwise(none))
    return F.filter(F.transform(whole, lambda s: F.trim(s)), lambda s: s.rlike(r"\p{L}"))


def split_sentences(docs: DataFrame, doc_id: str, text: str, model: Model) -> DataFrame:
    """One row per sentence: document, number, sentence."""
    rows = docs.select(doc_id, F.posexplode_outer(sentences(F.col(text), model)).alias("sent_no", "sentence"))
    return rows.filter("sent_no is not null")
