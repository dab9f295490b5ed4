"""Predicates over one grid row, an ``array<string>`` of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiframe.functions.columns import is_blank, let, word_count
from lexiframe.functions.lexicons import FOOTER_WORDS
from lexiframe.functions.normalize import strip

# What makes a row a header.
MIN_HEADER_CELLS = 3
MAX_HEADER_WORDS = 3
MIN_HEADER_TEXT = 0.6


def filled(cells: Column) -> Column:
    return F.filter(cells, lambda c: ~is_blank(c))


def filled_count(cells: Column) -> Column:
    return F.size(filled(cells))


def start_index(cells: Column) -> Column:
    """Index of the first filled cell, -1 in a blank row."""
    return (F.array_position(F.transform(cells, lambda c: ~is_blank(c)), True) - 1).cast("int")


def from_index(cells: Column, start: Column) -> Column:
    """Cells from ``start`` on; an empty array when the row ends before."""
    return F.slice(cells, start + 1, F.greatest(F.size(cells) - start, F.lit(0)))


def trim_cells(cells: Column) -> Column:
    return let(start_index(cells), lambda s: F.when(s >= 0, from_index(cells, s)))


def is_valid_header(cells: Column, is_text: Column | None = None) -> Column:
    """Three or more filled cells, few words in each, mostly text.

    ``is_text`` flags each cell that was typed as text; without it every cell
    counts as text.
    """

    def test(full: Column) -> Column:
        n = F.size(full)
        words = F.aggregate(full, F.lit(0), lambda acc, c: acc + word_count(c))
        return (n >= MIN_HEADER_CELLS) & (words <= n * MAX_HEADER_WORDS)

    ok = let(filled(cells), test)
    if is_text is not None:
        typed = F.filter(
            F.arrays_zip(cells.alias("c"), is_text.alias("t")), lambda x: ~is_blank(x["c"])
        )
        texts = F.size(F.filter(typed, lambda x: x["t"]))
        ok = ok & (texts >= F.size(typed) * MIN_HEADER_TEXT)
    return F.coalesce(ok, F.lit(False))


def has_split_headers(header: Column, below: Column) -> Column:
    """A blank header cell with a filled cell under it."""
    pairs = F.zip_with(header, below, lambda h, n: is_blank(h) & ~is_blank(n))
    return F.coalesce(F.exists(pairs, lambda p: p), F.lit(False))


def clean_headers(cells: Column) -> Column:
    """Stripped names without the blank ones."""
    return F.transform(filled(cells), lambda c: strip(c))


def header_slots(cells: Column) -> Column:
    """``array<struct<name, at>>``: each name with the cell index it stands over.

    A name that occurs twice keeps its first place and its last cell.
    """
    placed = F.filter(
        F.transform(cells, lambda c, i: F.struct(strip(c).alias("name"), i.alias("at"))),
        lambda x: ~is_blank(x["name"]),
    )

    def merge(slots: Column) -> Column:
        names = F.array_distinct(F.transform(slots, lambda x: x["name"]))

        def last_of(name: Column) -> Column:
            same = F.filter(slots, lambda x: x["name"] == name)
            return F.struct(name.alias("name"), F.element_at(same, -1)["at"].alias("at"))

        return F.transform(names, lambda n: last_of(n))

    return let(placed, merge)


def is_footer(cells: Column) -> Column:
    """The first non-empty cell mentions a total, summary, remarks or notes."""
    first = F.lower(F.get(F.filter(cells, lambda c: c.isNotNull() & (c != "")), F.lit(0)))
    return F.coalesce(first.rlike("|".join(FOOTER_WORDS)), F.lit(False))


# no type suffixes: 12d and 3f are codes, not numbers
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def is_number_or_null(c: Column) -> Column:
    return c.isNull() | c.rlike(NUMBER)


def is_boolean_or_null(c: Column) -> Column:
    return c.isNull() | F.lower(c).isin("true", "false")
