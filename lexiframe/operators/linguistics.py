"""Token tables and per-document results as DataFrame operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import linguistics as L
from lexiframe.functions import tokens as T
from lexiframe.functions.columns import unnest
from lexiframe.functions.stopwords import WORDS, stopwords
from lexiframe.operators.gazetteer import SHARD_BYTES, entities, with_hits

TOKENS = "tokens"
WORDS_COLUMN = "words"


def stop_lists(languages: Sequence[str] = ("en",)) -> dict[str, list[str]]:
    return {lang: stopwords(lang) for lang in languages}


def with_tokens(
    df: DataFrame,
    text: str,
    lang: str | None = None,
    words: Mapping[str, Sequence[str]] | None = None,
    annotate: bool = False,
    heads: bool = False,
    fields: Sequence[str] = T.ANNOTATIONS,
) -> DataFrame:
    """Add the token array of a text column; no shuffle, one row per document as before.

    ``fields`` names the annotations that are wanted: an array's fields are all made, read or not.
    """
    if words is None:
        words = stop_lists(tuple(WORDS) if lang else ("en",))
    column = T.doc_tokens(F.col(text), T.stop_flags(words, F.col(lang) if lang else None))
    if annotate or heads:
        column = T.annotate_tokens(column, fields)
    if heads:
        column = T.attach_heads(column, fields)
    return df.withColumn(TOKENS, column)


def with_content_words(
    df: DataFrame, text: str, lang: str | None = None, words: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Add the lower-cased content words of a text column in order, for steps that need no other tokens."""
    if words is None:
        words = stop_lists(tuple(WORDS) if lang else ("en",))
    return df.withColumn(WORDS_COLUMN, T.content_words(F.col(text), words, F.col(lang) if lang else None))


def tokenize(df: DataFrame, doc_id: str, text: str, lang: str | None = None, **options) -> DataFrame:
    """One row per token."""
    return token_rows(with_tokens(df, text, lang, **options), doc_id)


def token_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """The token arrays as a token table."""
    return unnest(docs, keep, F.col(TOKENS), "tok_id")


def tagged_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """The token table with word classes, found in its own rows: compiled code, where an array's elements are interpreted."""
    return token_rows(docs, *keep).withColumn("pos", T.pos_of(F.col("text"), F.col("lower"), F.col("is_alpha")))


def assemble(tokens: DataFrame, doc_id: str, docs: DataFrame | None = None) -> DataFrame:
    """A token table back to one row per document, tokens in order.

    A group is one document, which was one row before. ``docs`` adds documents
    without tokens.
    """
    fields = [c for c in tokens.columns if c not in (doc_id, "tok_id")]
    grouped = tokens.groupBy(doc_id).agg(
        F.sort_array(F.collect_list(F.struct("tok_id", *fields))).alias(TOKENS)
    )
    if docs is None:
        return grouped
    return docs.select(doc_id).join(grouped, doc_id, "left").withColumn(
        TOKENS, F.coalesce(F.col(TOKENS), F.array())
    )


def flag_stopwords(tokens: DataFrame, words: DataFrame, lang: str = "lang") -> DataFrame:
    """``is_stop`` by a table of ``(lang, word)``; its size decides how Spark joins it."""
    listed = words.select(
        F.col("lang").alias(lang), F.col("word").alias("lower"), F.lit(True).alias("__stop")
    ).distinct()
    joined = tokens.join(listed, [lang, "lower"], "left")
    return joined.withColumn("is_stop", F.coalesce("__stop", F.lit(False))).drop("__stop")


def tag_pos(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``pos`` by a table of ``(word, pos)``, else by word ending, else X."""
    listed = lexicon.select(F.col("word").alias("lower"), F.col("pos").alias("__pos")).dropDuplicates(
        ["lower"]
    )
    by_rule = T.pos_of(F.col("text"), F.col("lower"), F.col("is_alpha"))
    joined = tokens.join(listed, "lower", "left")
    return joined.withColumn("pos", F.coalesce("__pos", by_rule)).drop("__pos")


def split_sentences(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = df.select(doc_id, F.posexplode_outer(T.sentences(F.col(text))).alias("sent_no", "sentence"))
    return rows.filter("sent_no is not null")


def match_entities(docs: DataFrame, doc_id: str, gazetteer: DataFrame, max_n: int | None = None) -> DataFrame:
    """Phrases of the gazetteer ``(phrase, label)`` found in token arrays, one row each.

    Reading from the left, the longest phrase at a token wins and its tokens are
    used up. Rows: document, entity number, text, label, first and last token. With
    ``max_n`` longer phrases are left out. See ``gazetteer.with_hits``: nothing shuffles.
    """
    if max_n is not None:
        gazetteer = gazetteer.filter(F.size(F.split("phrase", " ")) <= max_n)
    tokens = F.col(TOKENS)
    rows = docs.select(doc_id, tokens["text"].alias("__texts"), tokens["lower"].alias("__lowers"))
    found = with_hits(rows, gazetteer, F.col("__lowers"), "__hits")
    each = found.select(doc_id, F.posexplode(entities(F.col("__hits"), F.col("__texts"))).alias("ent_id", "e"))
    return each.select(doc_id, "ent_id", "e.text", "e.label", "e.first", "e.last")


def text_entities(
    df: DataFrame, text: str, gazetteer: DataFrame, mode: str, name: str = "entities", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Replace a text column by the string of its entities. Only the token strings go to Python, and once back."""
    tokens = T.token_texts(F.coalesce(F.col(text), F.lit("")))
    rows = df.withColumn(text, tokens)
    found = with_hits(rows, gazetteer, F.transform(F.col(text), lambda t: F.lower(t)), "__hits", shard_bytes)
    string = L.entity_string(entities(F.col("__hits"), F.col(text)), mode)
    return found.withColumn(name, string).drop("__hits", *([text] if text != name else []))


def entity_strings(
    docs: DataFrame, doc_id: str, entities: DataFrame, mode: str, name: str = "entities"
) -> DataFrame:
    """One string per document; documents without entities get the mode's text."""
    grouped = entities.groupBy(doc_id).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ent_id", "text", "label"))),
            lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label")),
        ).alias("__ents")
    )
    joined = docs.join(grouped, doc_id, "left")
    return joined.withColumn(name, L.entity_string(F.col("__ents"), mode)).drop("__ents")


def summarize_tokens(tokens: DataFrame, doc_id: str) -> DataFrame:
    """Counts per document straight from a token table, combined before the shuffle."""
    alpha = F.col("is_alpha")
    counts = [F.sum((F.col("pos") == pos).cast("int")).alias(name) for name, pos in L.WEIGHTED_POS.items()]
    return tokens.groupBy(doc_id).agg(
        F.sum(alpha.cast("int")).alias("words"),
        F.sum((alpha & F.col("is_stop")).cast("int")).alias("stopwords"),
        F.sum(F.when(alpha, F.length("text"))).alias("letters"),
        *counts,
    )
