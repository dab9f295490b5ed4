"""A document as an array of token structs, built and read row by row.

``doc_tokens`` turns one text into ``array<struct<tok_id, sent_id, text, lower,
is_alpha, is_stop>>``. Everything a document needs lies in its own row, so the
functions here cause no shuffle; ``operators.linguistics`` also offers them for
token tables with one row per token.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.functions import lexicons
from lexiframe.functions.columns import const_map, is_one_of, let

TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
WORD = r"[\p{L}\p{M}]+"
# a stretch up to and including its closing marks; covers the whole text
SENTENCE_PIECE = r"[^.!?]*[.!?]+|[^.!?]+"
SENTENCE = r"[^.!?]+[.!?]*"

BASE_FIELDS = ("tok_id", "sent_id", "text", "lower", "is_alpha", "is_stop")
ANNOTATIONS = ("pos", "lemma", "morph")


def token_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_lowers(text: Column) -> Column:
    """The lower-cased tokens of a text."""
    return F.transform(token_texts(F.coalesce(text, F.lit(""))), lambda t: F.lower(t))


def is_alpha(token: Column) -> Column:
    return token.rlike(r"^\p{L}+$")


def stop_flags(
    words: Mapping[str, Sequence[str]], lang: Column | None = None, default: str = "en"
):
    """A flag for each lower-cased token, from the word set of the row's language, which is chosen once a row."""

    def among(lowers: Column, listed: Sequence[str]) -> Column:
        return F.transform(lowers, lambda w: is_one_of(w, listed))

    def flags(lowers: Column) -> Column:
        if lang is None:
            return among(lowers, words[default])
        branch = F.transform(lowers, lambda w: F.lit(False))
        for code, listed in words.items():
            branch = F.when(lang == code, among(lowers, listed)).otherwise(branch)
        return branch

    return flags


def content_words(text: Column, words: Mapping[str, Sequence[str]], lang: Column | None = None, default: str = "en") -> Column:
    """The lower-cased words of a text that are no stop words: those of ``doc_tokens``, without making the tokens.

    No closing mark is part of a word, so the text need not be cut into sentences first.
    """

    def found(t: Column) -> Column:
        marked = F.filter(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: is_alpha(w))
        return F.when(t.rlike(r"\p{M}"), marked).otherwise(F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0)))

    def kept(lowers: Column) -> Column:
        def without(listed: Sequence[str]) -> Column:
            return F.filter(lowers, lambda w: ~is_one_of(w, listed))

        if lang is None:
            return without(words[default])
        branch = lowers
        for code, listed in words.items():
            branch = F.when(lang == code, without(listed)).otherwise(branch)
        return branch

    return let(F.transform(found(F.coalesce(text, F.lit(""))), lambda w: F.lower(w)), kept)


def sentences(text: Column) -> Column:
    """Stretches closed by ``.``, ``!`` or ``?`` that hold a letter."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s.rlike(r"\p{L}"))


def zipped(**arrays: Column) -> Column:
    """Equally long arrays as one array of structs; cheaper than building structs one by one."""
    return F.arrays_zip(*(array.alias(name) for name, array in arrays.items()))


def extended(tokens: Column, **arrays: Column) -> Column:
    """Token structs with further fields."""
    return zipped(**{name: tokens[name] for name in BASE_FIELDS}, **arrays)


def doc_tokens(text: Column, stops) -> Column:
    """The token structs of a text, in order. ``sent_id`` numbers the stretches between closing marks."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE_PIECE), F.lit(0))

    def described(texts: Column, sents: Column) -> Column:
        return let(
            F.transform(texts, lambda t: F.lower(t)),
            lambda lowers: zipped(
                tok_id=F.transform(texts, lambda t, i: i),
                sent_id=sents,
                text=texts,
                lower=lowers,
                is_alpha=F.transform(texts, lambda t: is_alpha(t)),
                is_stop=stops(lowers),
            ),
        )

    def flat(nested: Column) -> Column:
        sents = F.flatten(F.transform(nested, lambda ts, i: F.array_repeat(i, F.size(ts))))
        return let(F.flatten(nested), lambda texts: described(texts, sents))

    return let(F.transform(pieces, lambda piece: token_texts(piece)), flat)


def _may_end_in(lower: Column, endings: Sequence[str]) -> Column:
    """Hash probes on the last letters, so that only likely words meet a regex."""
    test = F.lit(False)
    for size in sorted({len(e) for e in endings}):
        test = test | F.substring(lower, -size, size).isin([e for e in endings if len(e) == size])
    return test


def pos_of(text: Column, lower: Column, alpha: Column) -> Column:
    """Word class from the lexicon, then from the ending, else X."""
    other = F.when(text.rlike(r"^\p{N}+$"), F.lit("NUM"))
    other = other.when(text.rlike(r"^\p{P}$"), F.lit("PUNCT")).otherwise("SYM")

    known = F.lit("X")
    for pos, listed in reversed(lexicons.POS_WORDS.items()):
        known = F.when(is_one_of(lower, listed.split()), F.lit(pos)).otherwise(known)

    ending = F.lit("X")
    for pos, endings in reversed(lexicons.POS_SUFFIXES):
        pattern = f"^.{{2,}}({'|'.join(endings)})$"
        ending = F.when(lower.rlike(pattern), F.lit(pos)).otherwise(ending)

    words = " ".join(lexicons.POS_WORDS.values()).split()
    endings = [e for _, listed in lexicons.POS_SUFFIXES for e in listed]
    return (
        F.when(~alpha, other)
        .when(is_one_of(lower, words), known)
        .when(_may_end_in(lower, endings), ending)
        .otherwise("X")
    )


def lemma_of(lower: Column, pos: Column) -> Column:
    """Irregular forms from the table, plural endings, verb endings of known verbs, else the word."""
    verbs = lexicons.POS_WORDS["VERB"].split()
    stem = F.regexp_replace(lower, "(ing|ed)$", "")
    in_s = (
        F.when(lower.rlike("^.{3,}ies$"), F.regexp_replace(lower, "ies$", "y"))
        .when(lower.rlike("^.{2,}sses$"), F.regexp_replace(lower, "es$", ""))
        .when(
            pos.isin("NOUN", "VERB", "X") & lower.rlike("^.{2,}[^siu]s$"),
            F.regexp_replace(lower, "s$", ""),
        )
        .otherwise(lower)
    )
    verb_form = (
        F.when(is_one_of(stem, verbs), stem)
        .when(is_one_of(F.concat(stem, F.lit("e")), verbs), F.concat(stem, F.lit("e")))
        .otherwise(lower)
    )
    return (
        F.when(
            is_one_of(lower, lexicons.LEMMAS), F.element_at(const_map(lexicons.LEMMAS), lower)
        )
        .when(lower.endswith("s"), in_s)
        .when((pos == "VERB") & (lower.endswith("ing") | lower.endswith("ed")), verb_form)
        .otherwise(lower)
    )


def morph_of(lower: Column, pos: Column) -> Column:
    """Feature string in ``Name=Value|Name=Value`` form, empty where the ending says nothing."""
    return (
        F.when((pos == "VERB") & lower.endswith("ing"), "Tense=Pres|VerbForm=Part")
        .when((pos == "VERB") & lower.endswith("ed"), "Tense=Past|VerbForm=Fin")
        .when(pos == "VERB", "VerbForm=Inf")
        .when((pos == "NOUN") & lower.rlike("[^su]s$"), "Number=Plur")
        .when(pos == "NOUN", "Number=Sing")
        .when(pos == "ADJ", "Degree=Pos")
        .otherwise("")
    )


def annotate_tokens(tokens: Column, fields: Sequence[str] = ANNOTATIONS) -> Column:
    """Add ``pos``, ``lemma`` and ``morph`` to each token struct, or those of ``fields``, of which ``pos`` is one."""
    rules = {"lemma": lemma_of, "morph": morph_of}

    def tagged(toks: Column, tags: Column) -> Column:
        return extended(toks, pos=tags, **{name: F.zip_with(toks["lower"], tags, rules[name]) for name in fields if name != "pos"})

    def tag(t: Column) -> Column:
        return pos_of(t["text"], t["lower"], t["is_alpha"])

    return let(
        tokens, lambda toks: let(F.transform(toks, lambda t: tag(t)), lambda tags: tagged(toks, tags))
    )


def link_label(t: Column, head: Column) -> Column:
    """Label of a token's link by its class and on which side of its head it stands."""
    noun = t["pos"].isin("NOUN", "PRON", "X")
    return (
        F.when(t["tok_id"] == head, "ROOT")
        .when(t["lower"].isin(list(lexicons.NEGATION_CUES)), "neg")
        .when(t["pos"].isin("PUNCT", "SYM"), "punct")
        .when(noun & (t["tok_id"] < head), "nsubj")
        .when(noun, "dobj")
        .when(t["pos"] == "ADJ", "amod")
        .when(t["pos"] == "DET", "det")
        .when(t["pos"] == "ADP", "prep")
        .when(t["pos"] == "ADV", "advmod")
        .otherwise("dep")
    )


def with_links(tokens: Column, heads: Column, fields: Sequence[str] = ANNOTATIONS) -> Column:
    """Add ``dep`` and ``head_tok_id`` from an array of each token's head."""

    def linked(toks: Column, h: Column) -> Column:
        return extended(
            toks,
            **{name: toks[name] for name in fields},
            dep=F.zip_with(toks, h, link_label),
            head_tok_id=h,
        )

    return let(tokens, lambda toks: let(heads, lambda h: linked(toks, h)))


def attach_heads(tokens: Column, fields: Sequence[str] = ANNOTATIONS) -> Column:
    """Add ``dep`` and ``head_tok_id`` by position, for texts that come without a parse.

    A sentence's root is its first verb, else its first word. Every other token
    hangs on the root; the label follows its word class and side.
    """

    def root(toks: Column) -> Column:
        verbs = F.filter(toks, lambda t: t["pos"].isin("VERB", "AUX"))
        words = F.filter(toks, lambda t: t["is_alpha"])
        first = F.coalesce(F.get(verbs, F.lit(0)), F.get(words, F.lit(0)), F.get(toks, F.lit(0)))
        return first["tok_id"]

    def parsed(toks: Column) -> Column:
        heads = F.flatten(
            F.transform(by_sentence(toks), lambda part: F.array_repeat(root(part), F.size(part)))
        )
        return with_links(toks, heads, fields)

    return let(tokens, parsed)


def by_sentence(tokens: Column) -> Column:
    """Cut a token array into one array per sentence; linear in the document."""

    def cut(toks: Column, sents: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(toks) - 1),
            lambda i: (i == 0) | (F.get(sents, i) != F.get(sents, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.slice(toks, at + 1, F.coalesce(F.get(s, k + 1), F.size(toks)) - at),
            ),
        )

    return let(
        tokens,
        lambda t: F.when(F.size(t) > 0, let(t["sent_id"], lambda s: cut(t, s))).otherwise(F.array()),
    )
