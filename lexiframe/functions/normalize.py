"""Text normalisation as column expressions.

Each step scans the text only when a cheap substring test says it can
change something, so clean text costs little more than the whitespace pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import lexicons
from lexiframe.functions.columns import MAYBE_RARE_WS, RARE_WS, WS, let, replace_words

HTML_TAG = "(?d)<.*?>"
# white space that is not one plain space; leaves the many single spaces alone
UNEVEN_WS = r"\s(?:\s+|(?<! ))"
# marks that the last step turns into spaces (the first two) or drops
MARKS = ":_\"'"
URL = f"https?://[^{WS}]+|www\\.[^{WS}]+"
# a word with inner apostrophes, or a stretch between words
CONTRACTION_PIECE = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+"
EMOJI_CLASS = r"\x{203C}-\x{3299}\x{1F004}-\x{1FAFF}"
EMOJI_PIECE = f"[{EMOJI_CLASS}]|[^{EMOJI_CLASS}]+"
# variation selector and joiner inside emoji sequences
EMOJI_GLUE = "\ufe0f\u200d"


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def lower_strip(c: Column) -> Column:
    return F.lower(strip(c))


def strip_html(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, HTML_TAG, "")).otherwise(c)


def strip_urls(c: Column) -> Column:
    maybe = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www."))
    return F.when(maybe, F.regexp_replace(c, URL, "")).otherwise(c)


def expand_contractions(c: Column, table: Mapping[str, str] | None = None) -> Column:
    """Expand whole-word contractions; the match ignores case and the apostrophe's shape."""
    table = table or lexicons.contractions()

    def piece(p: Column) -> Column:
        return replace_words(p, F.lower(F.translate(p, "’", "'")), table)

    pieces = F.regexp_extract_all(c, F.lit(CONTRACTION_PIECE), F.lit(0))
    maybe = F.contains(c, F.lit("'")) | F.contains(c, F.lit("’"))
    return F.when(maybe, F.array_join(F.transform(pieces, piece), "")).otherwise(c)


def expand_chat_words(c: Column, table: Mapping[str, str] | None = None) -> Column:
    """Expand chat shorthand that stands alone between spaces; words are re-joined by one space."""
    table = table or lexicons.CHAT_WORDS
    longest = max(map(len, table), default=0)  # upper case is never shorter

    def word(w: Column) -> Column:
        return F.when(F.length(w) <= longest, replace_words(w, F.upper(w), table)).otherwise(w)

    return F.array_join(F.transform(F.split(collapse_ws(c), " "), word), " ")


def demojize(c: Column, names: Mapping[int, str] | None = None) -> Column:
    """Replace each emoji by ``:name_with_underscores:``, looked up by code point."""
    names = names or lexicons.emoji_names()
    low, high = lexicons.EMOJI_GAP
    slots = [
        f":{names[cp].replace(' ', '_')}:" if cp in names else ""
        for cp in (*range(lexicons.EMOJI_BASE, low), *range(high + 1, lexicons.EMOJI_END + 1))
    ]
    table = F.split(F.lit("\n".join(slots)), "\n")

    def piece(p: Column) -> Column:
        cp = F.ascii(p)
        slot = F.when(cp >= high + 1, cp - (high + 1) + (low - lexicons.EMOJI_BASE)).when(
            (cp >= lexicons.EMOJI_BASE) & (cp < low), cp - lexicons.EMOJI_BASE
        )
        name = F.get(table, slot)
        return F.when(name != "", name).otherwise(p)

    plain = F.translate(c, EMOJI_GLUE, "")
    pieces = F.regexp_extract_all(plain, F.lit(EMOJI_PIECE), F.lit(0))
    return F.when(
        c.rlike(f"[{EMOJI_CLASS}]"), F.array_join(F.transform(pieces, piece), "")
    ).otherwise(c)


def split_colon_underscore(c: Column) -> Column:
    return F.translate(c, ":_", "  ")


def strip_quotes(c: Column) -> Column:
    return F.translate(c, "\"'", "")


def plain_marks(c: Column) -> Column:
    """Both steps above at once."""
    return F.when(c.rlike(f"[{MARKS}]"), F.translate(c, MARKS, "  ")).otherwise(c)


def plain_spaces(c: Column) -> Column:
    """Turn the whitespace Java's ``\\s`` does not know into plain spaces."""
    return F.when(c.rlike(MAYBE_RARE_WS), F.regexp_replace(c, f"[{RARE_WS}]", " ")).otherwise(c)


def collapse_ws(c: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(plain_spaces(c), UNEVEN_WS, " "))


def normalize_text(
    c: Column,
    contractions: Mapping[str, str] | None = None,
    chat_words: Mapping[str, str] | None = None,
) -> Column:
    """The whole chain. Null stays null.

    Staged through ``let`` so that each step's input is computed once,
    although its guard and its rewrite both read it.
    """
    steps = (
        strip_html,
        strip_urls,
        lambda t: expand_contractions(t, contractions),
        lambda t: expand_chat_words(t, chat_words),
        demojize,
    )
    value = F.lower(c)
    for step in steps:
        value = let(value, step)
    return let(let(value, plain_marks), collapse_ws)


def normalize_columns(df: DataFrame, cols: Sequence[str], keep_nulls: bool = False, **tables) -> DataFrame:
    """Overwrite each selected column with its normalised text; null becomes empty, or stays null on demand.

    A selected name that is not in the table is skipped.
    """
    text = (lambda c: c.cast("string")) if keep_nulls else null_to_empty
    present = [name for name in cols if name in df.columns]
    return df.withColumns({name: normalize_text(text(F.col(name)), **tables) for name in present})
