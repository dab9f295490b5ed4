"""SQL names for column functions. The bodies are SQL, so plans stay in Catalyst."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from lexiframe.functions import cells, lexicons, normalize
from lexiframe.functions.columns import MAYBE_RARE_WS, RARE_WS, WS


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(table: Mapping[str, str]) -> str:
    return ", ".join(_text(w) for w in table)


def _map(table: Mapping[str, str]) -> str:
    return "map(" + ", ".join(f"{_text(k)}, {_text(v)}" for k, v in table.items()) + ")"


def _replaced(word: str, key: str, table: Mapping[str, str]) -> str:
    return f"if({key} in ({_words(table)}), element_at({_map(table)}, {key}), {word})"


def bodies() -> dict[str, tuple[str, str, str]]:
    """Name -> (parameters, result type, body)."""
    ws_run, rare = _text(normalize.UNEVEN_WS), _text(f"[{RARE_WS}]")
    emoji = lexicons.emoji_names()
    names = {chr(cp): f":{name.replace(' ', '_')}:" for cp, name in emoji.items()}
    emoji_table = f"str_to_map({_text(chr(10).join(f'{k}{chr(9)}{v}' for k, v in names.items()))}, '\\n', '\\t')"
    pieces = f"""transform(
        regexp_extract_all(translate(c, {_text(normalize.EMOJI_GLUE)}, ''),
                           {_text(normalize.EMOJI_PIECE)}, 0),
        p -> coalesce(element_at({emoji_table}, p), p))"""
    contraction = _replaced("p", "lower(translate(p, '’', \"'\"))", lexicons.contractions())
    spaced = f"if(c rlike {_text(MAYBE_RARE_WS)}, regexp_replace(c, {rare}, ' '), c)"
    squeezed = f"trim(regexp_replace({spaced}, {ws_run}, ' '))"
    longest = max(map(len, lexicons.CHAT_WORDS))
    chat_word = f"if(length(w) <= {longest}, {_replaced('w', 'upper(w)', lexicons.CHAT_WORDS)}, w)"
    contracted = f"array_join(transform(regexp_extract_all(c, {_text(normalize.CONTRACTION_PIECE)}, 0), p -> {contraction}), '')"
    blank = f"(c is null or not c rlike {_text(f'[^{WS}]')})"
    return {
        "collapse_ws": ("c STRING", "STRING", squeezed),
        "strip_html": ("c STRING", "STRING", f"if(contains(c, '<'), regexp_replace(c, {_text(normalize.HTML_TAG)}, ''), c)"),
        "strip_urls": (
            "c STRING", "STRING",
            f"if(contains(c, 'http') or contains(c, 'www.'), regexp_replace(c, {_text(normalize.URL)}, ''), c)",
        ),
        "expand_contractions": (
            "c STRING", "STRING",
            f"if(contains(c, '\\'') or contains(c, '’'), {contracted}, c)",
        ),
        "expand_chat_words": (
            "c STRING", "STRING",
            f"array_join(transform(split(collapse_ws(c), ' '), w -> {chat_word}), ' ')",
        ),
        "demojize": (
            "c STRING", "STRING",
            f"if(c rlike {_text(f'[{normalize.EMOJI_CLASS}]')}, array_join({pieces}, ''), c)",
        ),
        "plain_marks": (
            "c STRING", "STRING",
            f"if(c rlike {_text(f'[{normalize.MARKS}]')}, translate(c, {_text(normalize.MARKS)}, '  '), c)",
        ),
        "normalize_text": (
            "c STRING", "STRING",
            "collapse_ws(plain_marks(demojize(expand_chat_words(expand_contractions("
            "strip_urls(strip_html(lower(c))))))))",
        ),
        "is_valid_header": (
            "cells ARRAY<STRING>", "BOOLEAN",
            f"""size(filter(cells, c -> not {blank})) >= {cells.MIN_HEADER_CELLS}
                and aggregate(filter(cells, c -> not {blank}), 0,
                              (n, c) -> n + size(split({squeezed}, ' ')))
                    <= size(filter(cells, c -> not {blank})) * {cells.MAX_HEADER_WORDS}""",
        ),
        "cosine": (
            "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE",
            """aggregate(array(struct(
                 aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) as d,
                 sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x)))
                   * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))) as n)),
               cast(null as double), (z, v) -> if(v.n = 0, 0D, v.d / v.n))""",
        ),
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions callable from SQL in this session; returns their names."""
    made = []
    for name, (params, kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
        made.append(name)
    return made
