"""Whole-column and whole-text enrichment, and reuse of results for repeated texts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import linguistics as L
from lexiframe.functions.normalize import normalize_columns, normalize_text
from lexiframe.functions.tokens import ANNOTATIONS, token_lowers
from lexiframe.operators import keyphrases as K
from lexiframe.operators.gazetteer import entities, with_hits
from lexiframe.operators.linguistics import TOKENS, with_tokens
from lexiframe.operators.skew import HOT_ROWS, hot_join

FAILED = "Processing failed"
HITS = "__hits"


def _with_tokens_and_hits(
    df: DataFrame, text: str, lang: str | None, words: Mapping[str, Sequence[str]] | None, gazetteer: DataFrame | None,
    fields: Sequence[str] = ANNOTATIONS,
) -> DataFrame:
    """Token arrays, and before them the phrases of a gazetteer, so that tokens need not pass through its walk."""
    if gazetteer is not None:
        df = with_hits(df, gazetteer, token_lowers(F.col(text)), HITS)
    return with_tokens(df, text, lang, words, heads=True, fields=fields)


def _entity_string(mode: str, gazetteer: DataFrame | None) -> Column:
    if gazetteer is None:
        return F.lit(L.NO_ENTITY[mode])
    return L.entity_string(entities(F.col(HITS), F.col(TOKENS)["text"]), mode)


def analyze_text(
    df: DataFrame,
    doc_id: str,
    text: str,
    lang: str | None = None,
    gazetteer: DataFrame | None = None,
    words: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One struct ``result`` per text with everything the single-text mode reports."""
    clean = df.select(doc_id, *([lang] if lang else []), normalize_text(F.col(text)).alias("clean"))
    docs = _with_tokens_and_hits(clean, "clean", lang, words, gazetteer)
    docs = K.keyphrases(docs, "text", "keyphrases").withColumn("entities", _entity_string("text", gazetteer))
    tokens = F.col(TOKENS)
    readability = L.readability_string(L.readability_metrics(F.col("clean"), tokens))
    result = F.struct(
        F.struct("clean", L.lemmatized_text(tokens).alias("lemmatized")).alias("text"),
        F.struct(
            L.pos_string(tokens, "text").alias("pos"),
            L.pos_weightage(tokens).alias("POS_weightage"),
            L.dependency_string(tokens, "text").alias("dependency"),
            L.morphology_string(tokens).alias("morphology"),
            L.negations(tokens).alias("negation"),
        ).alias("linguistics"),
        F.struct(
            L.keyword_stopword_ratio(tokens).alias("keyword_stopword_ratio"),
            readability.alias("readability"),
        ).alias("metrics"),
        "entities",
        "keyphrases",
    )
    return docs.select(doc_id, result.alias("result"))


def annotate_column(
    df: DataFrame,
    col: str,
    row_id: str,
    lang: str | None = None,
    gazetteer: DataFrame | None = None,
    words: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    docs = _with_tokens_and_hits(df, col, lang, words, gazetteer, fields=["pos"])
    docs = K.keyphrases(docs, "column", f"{col}__key_phrase").withColumn(f"{col}__ner", _entity_string("column", gazetteer))
    return docs.select(
        *df.columns,
        L.pos_string(F.col(TOKENS), "column").alias(f"{col}__pos"),
        L.dependency_string(F.col(TOKENS), "column").alias(f"{col}__dependency"),
        f"{col}__ner",
        f"{col}__key_phrase",
    )


def annotate_columns(df: DataFrame, cols: Sequence[str], row_id: str, **options) -> DataFrame:
    """Four result columns per selected column; a column that is not there gets an error column."""
    for col in cols:
        if col in df.columns:
            df = annotate_column(df, col, row_id, **options)
        else:
            df = df.withColumn(f"{col}__error", F.lit(FAILED))
    return df


def enrich(df: DataFrame, cols: Sequence[str], row_id: str, **options) -> DataFrame:
    """The column mode end to end: normalise the selected columns in place, then annotate them."""
    return annotate_columns(normalize_columns(df, cols), cols, row_id, **options)


def dedup_apply(
    df: DataFrame,
    key: str,
    row_id: str,
    fn: Callable[[DataFrame], DataFrame],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Run ``fn`` on distinct texts and give every row its text's result.

    For expensive ``fn`` (models); built-in expressions are cheaper applied to
    every row. ``fn`` takes and returns a table with ``key``. The distinct step
    combines before its shuffle, and the rows of a very frequent text are joined
    back in several parts.
    """
    distinct = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return hot_join(df, fn(distinct), [key], [row_id], hot_rows=hot_rows)
