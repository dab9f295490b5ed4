"""Per-document results over a token array, with the texts used when nothing is found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.functions import tokens as T
from lexiframe.functions.columns import let, round_binary

# Separators and the texts for "nothing found", per mode.
SEPARATOR = {"text": " , ", "column": " | "}
NO_POS = {"text": "No POS tags found", "column": "No pos found"}
NO_DEPENDENCY = {
    "text": "No dependnecy parsing found",
    "column": "No dependency parsing found for given row",
}
NO_ENTITY = {
    "text": "No entity relation found for given input",
    "column": "No entity relation found for given row",
}
NO_KEYPHRASE = {"text": "None", "column": "No key phrase found for given row"}
WEIGHTED_POS = {"Pronoun": "PRON", "Adjective": "ADJ", "Noun": "NOUN", "Verb": "VERB"}


def join_or(parts: Column, sep: str, empty: str) -> Column:
    """The parts joined, or ``empty`` when there are none; null parts are left out."""
    return let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, sep)).otherwise(empty))


def alpha(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["is_alpha"])


def content(tokens: Column) -> Column:
    """Words that are not stop words."""
    return F.filter(tokens, lambda t: t["is_alpha"] & ~t["is_stop"])


def pos_string(tokens: Column, mode: str) -> Column:
    parts = F.transform(alpha(tokens), lambda t: F.concat(t["text"], F.lit(" -> "), t["pos"]))
    return join_or(parts, SEPARATOR[mode], NO_POS[mode])


def pos_weightage(tokens: Column) -> Column:
    """Share of each class per hundred words, cut to a whole number.

    The numerator counts all tokens, the denominator words only.
    """

    def shares(toks: Column) -> Column:
        words = F.size(alpha(toks))
        entries = []
        for name, pos in WEIGHTED_POS.items():
            count = F.size(F.filter(toks, lambda t: t["pos"] == F.lit(pos)))
            entries += [F.lit(name), (count / words * 100).cast("int")]
        none = F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<int>")
        )
        return F.when(words > 0, F.create_map(*entries)).otherwise(none)

    return let(tokens, shares)


def _with_head(tokens: Column, line) -> Column:
    """Lines built from a token and its head. ``tok_id`` must count from 0 without gaps."""
    return let(
        tokens,
        lambda toks: F.transform(alpha(toks), lambda t: line(t, F.get(toks, t["head_tok_id"]))),
    )


def dependency_string(tokens: Column, mode: str) -> Column:
    def line(t: Column, head: Column) -> Column:
        link = [t["pos"], F.lit("->")] if mode == "column" else []
        return F.concat(
            t["text"], F.lit(" ->"), *link, t["dep"], F.lit(" -> "), head["text"]
        )

    return join_or(_with_head(tokens, line), SEPARATOR[mode], NO_DEPENDENCY[mode])


def entity_string(entities: Column, mode: str) -> Column:
    """``entities`` is an array of structs with ``text`` and ``label``."""
    if mode == "column":
        entities = F.filter(entities, lambda e: F.trim(e["text"]) != "")
    parts = F.transform(entities, lambda e: F.concat(e["text"], F.lit(" -> "), e["label"]))
    return join_or(F.coalesce(parts, F.array().cast("array<string>")), SEPARATOR[mode], NO_ENTITY[mode])


def lemmatized_text(tokens: Column) -> Column:
    return join_or(content(tokens)["lemma"], " ", "None")


def morphology_string(tokens: Column) -> Column:
    parts = F.transform(alpha(tokens), lambda t: F.concat(t["text"], F.lit(" -> "), t["morph"]))
    return join_or(parts, " , ", "None")


def negations(tokens: Column) -> Column:
    """``word -> head`` for every token labelled as a negation."""
    return let(
        tokens,
        lambda toks: F.transform(
            F.filter(toks, lambda t: t["dep"] == "neg"),
            lambda t: F.concat(t["text"], F.lit(" -> "), F.get(toks, t["head_tok_id"])["text"]),
        ),
    )


def lexical_negations(tokens: Column, cues) -> Column:
    """For texts without a parse: each cue word with the word after it."""
    return let(
        alpha(tokens),
        lambda words: F.filter(
            F.transform(
                words,
                lambda t, i: F.when(
                    t["lower"].isin(list(cues)),
                    F.concat(t["text"], F.lit(" -> "), F.get(words, i + 1)["text"]),
                ),
            ),
            lambda pair: pair.isNotNull(),
        ),
    )


def keyword_counts(tokens: Column) -> Column:
    """Struct of keyword count, stop word count and their ratio."""

    def counted(words: Column) -> Column:
        stops = F.size(F.filter(words, lambda t: t["is_stop"]))
        keys = F.size(words) - stops
        return F.struct(
            keys.alias("keywords"),
            stops.alias("stopwords"),
            round_binary(keys / (stops + 1), 2).alias("ratio"),
        )

    return let(alpha(tokens), counted)


def keyword_stopword_ratio(tokens: Column) -> Column:
    return let(
        keyword_counts(tokens),
        lambda c: F.concat(
            F.lit("keywords -> "), c["keywords"].cast("string"),
            F.lit(" , stopwords -> "), c["stopwords"].cast("string"),
            F.lit(" , ratio -> "), c["ratio"].cast("string"),
        ),
    )


def readability_metrics(text: Column, tokens: Column) -> Column:
    """Struct of mean sentence length, mean word length and their weighted sum."""

    def metrics(base: Column) -> Column:
        per_sentence = F.coalesce(base["words"] / F.nullif(base["sents"], F.lit(0)), F.lit(0.0))
        per_word = F.coalesce(base["letters"] / F.nullif(base["words"], F.lit(0)), F.lit(0.0))
        return F.struct(
            round_binary(per_sentence, 2).alias("avg_sentence_length"),
            round_binary(per_word, 2).alias("avg_word_length"),
            round_binary(per_sentence * 0.6 + per_word * 0.4, 2).alias("complexity_score"),
        )

    def base(words: Column) -> Column:
        letters = F.aggregate(words, F.lit(0), lambda acc, t: acc + F.length(t["text"]))
        return F.struct(
            F.size(words).alias("words"),
            F.size(T.sentences(F.coalesce(text, F.lit("")))).alias("sents"),
            letters.alias("letters"),
        )

    return let(let(alpha(tokens), base), metrics)


def readability_string(metrics: Column) -> Column:
    def line(m: Column) -> Column:
        parts = []
        for i, name in enumerate(("avg_sentence_length", "avg_word_length", "complexity_score")):
            parts += [F.lit(f"{' , ' if i else ''}{name} -> "), m[name].cast("string")]
        return F.concat(*parts)

    return let(metrics, line)
