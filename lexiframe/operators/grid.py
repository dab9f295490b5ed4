"""From raw grids ``(file, row_idx, cells)`` to checked tables.

``row_idx`` counts the rows of a file from 0. Everything that only concerns the
top of a file first cuts to those rows, so no file is gathered whole; facts about
a file go back to its rows by a join that spreads large files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import cells as C
from lexiframe.functions.columns import is_blank, is_one_of, let
from lexiframe.functions.lexicons import NA_STRINGS
from lexiframe.operators.skew import hot_join

# Rows and shares of the structure checks.
FIRST_SCAN, UNIQUE_SCAN = 10, 20
KEY_VALUE_ROWS, KEY_VALUE_CELLS, KEY_VALUE_SHARE = 20, 2, 0.7
STRUCTURE_ROWS, STRUCTURE_FILL, STRUCTURE_SHARE = 50, 0.5, 0.6
MIN_ROWS = 2
NO_HEADER = "no_valid_header"
NO_TABLE = "no_table_found"
MANY_TABLES = "multiple_tables"
SPLIT_HEADER = "split_header"
KEY_VALUE = "key_value_format"
NOT_STRUCTURED = "not_structured"
TOO_FEW_ROWS = "not_enough_rows"


def trim_grid(grid: DataFrame) -> DataFrame:
    """Cut the empty cells before a row's first filled one; blank rows go."""
    return (
        grid.withColumn("start_idx", C.start_index(F.col("cells")))
        .filter("start_idx >= 0")
        .withColumn("cells", C.from_index(F.col("cells"), F.col("start_idx")))
    )


def locate_header(grid: DataFrame, mode: str = "first", scan: int | None = None) -> DataFrame:
    """One row per file: header row, its start and trimmed cells, or why there is none.

    ``first`` takes the first valid row of ten, ``unique`` wants exactly one
    among twenty. The aggregate keeps one candidate per file before it shuffles.
    """
    scan = scan or (FIRST_SCAN if mode == "first" else UNIQUE_SCAN)
    start = C.start_index(F.col("cells"))
    top = grid.filter(F.col("row_idx") < scan).select(
        "file", "row_idx", start.alias("start_idx"), C.trim_cells(F.col("cells")).alias("header")
    )
    valid = F.col("header").isNotNull() & C.is_valid_header(F.col("header"))
    found = top.groupBy("file").agg(
        F.sum(valid.cast("int")).alias("candidates"),
        F.min(F.when(valid, F.struct("row_idx", "start_idx", "header"))).alias("h"),
    )
    none = NO_HEADER if mode == "first" else NO_TABLE
    problem = F.when(F.col("candidates") == 0, none)
    if mode == "unique":
        problem = problem.when(F.col("candidates") > 1, MANY_TABLES)
    ok = problem.isNull()
    return found.select(
        "file",
        F.when(ok, F.col("h.row_idx")).alias("header_row"),
        F.when(ok, F.col("h.start_idx")).alias("start_idx"),
        F.when(ok, F.col("h.header")).alias("header"),
        problem.alias("problem"),
    )


def split_headers(grid: DataFrame, headers: DataFrame, scan: int = UNIQUE_SCAN) -> DataFrame:
    """One row per file with a header: is it spread over two rows?"""
    below = grid.filter(F.col("row_idx") <= scan).select(
        "file", (F.col("row_idx") - 1).alias("header_row"), F.col("cells").alias("below")
    )
    joined = headers.filter("header_row is not null").join(below, ["file", "header_row"], "left")
    return joined.select(
        "file",
        C.has_split_headers(
            F.col("header"), C.from_index(F.col("below"), F.col("start_idx"))
        ).alias("is_split"),
    )


def data_rows(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """The rows under each file's header, cut to start at the header's first column."""
    found = headers.filter("header_row is not null").select("file", "header_row", "start_idx")
    joined = hot_join(grid, found, ["file"], ["row_idx"], "inner")
    return joined.filter("row_idx > header_row").select(
        "file", "row_idx", C.from_index(F.col("cells"), F.col("start_idx")).alias("cells")
    )


def cut_footer(rows: DataFrame) -> DataFrame:
    """Drop each file's first footer row and everything after it."""
    footers = (
        rows.filter(C.is_footer(F.col("cells")))
        .groupBy("file")
        .agg(F.min("row_idx").alias("footer_row"))
    )
    joined = hot_join(rows, footers, ["file"], ["row_idx"])
    return joined.filter("footer_row is null or row_idx < footer_row").drop("footer_row")


def drop_blank_rows(rows: DataFrame, kind: str = "excel") -> DataFrame:
    """Spreadsheets lose rows without a filled cell, delimited files those with a blank first cell."""
    if kind == "excel":
        return rows.filter(F.exists("cells", lambda c: ~is_blank(c)))
    first = F.get("cells", F.lit(0))
    return rows.filter(first.isNull() | ~is_blank(first))


def extract_rows(grid: DataFrame, mode: str = "first") -> DataFrame:
    """Header search, footer cut and blank rows in one go."""
    return drop_blank_rows(cut_footer(data_rows(grid, locate_header(grid, mode))))


def grid_to_table(rows: DataFrame, header: Sequence[str | None], keep: Sequence[str] = ()) -> DataFrame:
    """Cells to named string columns; short rows get nulls, of equal names the last cell counts."""
    slots: dict[str, int] = {}
    for at, name in enumerate(header):
        if name is not None and name.strip():
            slots[name.strip()] = at
    return rows.select(
        *keep, *(F.get("cells", F.lit(at)).alias(name) for name, at in slots.items())
    )


def table_cells(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """The same for files with different headers: one row per filled header and row."""
    slots = headers.filter("header is not null").select(
        "file", C.header_slots(F.col("header")).alias("slots")
    )
    joined = hot_join(rows, slots, ["file"], ["row_idx"], "inner")
    return joined.select("file", "row_idx", "cells", F.explode("slots").alias("s")).select(
        "file", "row_idx", F.col("s.name").alias("column"), F.get("cells", F.col("s.at")).alias("value")
    )


def _count_share(rows: Column, test) -> Column:
    return F.size(F.filter(rows, test))


def is_key_value(rows: Column) -> Column:
    """More than 70 % of the first 20 rows have at most two filled cells."""
    head = F.slice(rows, 1, KEY_VALUE_ROWS)
    low = _count_share(head, lambda r: C.filled_count(r) <= KEY_VALUE_CELLS)
    return low > F.size(head) * KEY_VALUE_SHARE


def is_structured(rows: Column, columns: Column) -> Column:
    """At least 60 % of the first 50 rows fill at least half the columns."""
    head = F.slice(rows, 1, STRUCTURE_ROWS)
    good = _count_share(head, lambda r: C.filled_count(r) >= columns * STRUCTURE_FILL)
    return good >= F.size(head) * STRUCTURE_SHARE


def kept_csv_rows(rows: Column) -> Column:
    """Rows of a delimited file whose first cell is missing or has text."""
    return F.filter(rows, lambda r: F.get(r, F.lit(0)).isNull() | ~is_blank(F.get(r, F.lit(0))))


def sample_rows(grid: DataFrame, headers: DataFrame, n: int = STRUCTURE_ROWS) -> DataFrame:
    """Per file the ``n`` rows under its header, as one bounded array."""
    reach = UNIQUE_SCAN + n
    found = headers.filter("header_row is not null")
    top = grid.filter(F.col("row_idx") <= reach).join(found.select("file", "header_row", "start_idx"), "file")
    under = top.filter((F.col("row_idx") > F.col("header_row")) & (F.col("row_idx") <= F.col("header_row") + n))
    grouped = under.groupBy("file").agg(
        F.sort_array(
            F.collect_list(
                F.struct("row_idx", C.from_index(F.col("cells"), F.col("start_idx")).alias("cells"))
            )
        ).alias("sample")
    )
    return found.join(grouped, "file", "left").withColumn(
        "sample", F.coalesce(F.col("sample.cells"), F.array())
    )


def text_column_names(header: Column, rows: Column) -> Column:
    """Header names whose sampled cells are not all numbers and not all true/false."""

    def is_text(at: Column) -> Column:
        values = F.transform(rows, lambda r: missing_to_null(F.get(r, at)))
        numeric = F.forall(values, C.is_number_or_null)
        boolean = F.forall(values, C.is_boolean_or_null)
        return ~(numeric | boolean)

    slots = F.filter(C.header_slots(header), lambda s: is_text(s["at"]))
    return F.transform(slots, lambda s: s["name"])


def missing_to_null(c: Column) -> Column:
    return F.when(~is_one_of(c, NA_STRINGS), c)


def gate_values(sampled: DataFrame) -> DataFrame:
    """The structure checks of each file as columns."""
    rows, names = F.col("sample"), C.header_slots(F.col("header"))
    return sampled.select(
        "*",
        is_key_value(rows).alias("key_value"),
        is_structured(rows, F.size("header")).alias("structured"),
        F.size(kept_csv_rows(rows)).alias("data_rows"),
    ).withColumn("columns", let(names, lambda s: F.transform(s, lambda x: x["name"])))


def enough_rows(rows: DataFrame, keys: Sequence[str] = ("file",), least: int = MIN_ROWS) -> DataFrame:
    """Per file whether it has the least number of rows."""
    return rows.groupBy(*keys).agg((F.count("*") >= least).alias("enough"))


def validate_files(
    grid: DataFrame, kind: str = "csv", mode: str = "first", encodings: DataFrame | None = None
) -> DataFrame:
    """One row per file: status, columns and the first check that failed.

    With ``encodings``, rows of (file, encoding), the report names each file's encoding.
    """
    headers = locate_header(grid, mode)
    sampled = gate_values(sample_rows(grid, headers))
    if kind == "csv":
        failed = (
            F.when(F.col("key_value"), KEY_VALUE)
            .when(~F.col("structured"), NOT_STRUCTURED)
            .when(F.col("data_rows") < MIN_ROWS, TOO_FEW_ROWS)
        )
        names = text_column_names(F.col("header"), kept_csv_rows(F.col("sample")))
        checked = sampled.select("file", failed.alias("failed"), names.alias("names"))
    else:
        content = extract_rows(grid, mode).groupBy("file").agg(F.count("*").alias("n"))
        checked = (
            sampled.join(split_headers(grid, headers), "file", "left")
            .join(content, "file", "left")
            .select(
                "file",
                F.when(F.col("is_split"), SPLIT_HEADER).when(F.col("n").isNull(), TOO_FEW_ROWS).alias("failed"),
                F.col("columns").alias("names"),
            )
        )
    joined = headers.select("file", "problem").join(checked, "file", "left")
    problem = F.coalesce("problem", "failed")
    names = F.when(problem.isNull(), F.col("names"))
    status = (
        F.when(problem.isNotNull(), "Invalid_file")
        .when(F.size(names) > 0, "columns_extracted")
        .otherwise("no_columns_found")
    )
    report = joined.select("file", status.alias("status"), problem.alias("problem"), names.alias("columns"))
    return report if encodings is None else report.join(encodings.select("file", "encoding"), "file", "left")


def sample_head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in order; each task keeps ``n`` of its own before they meet."""
    return df.orderBy(*order).limit(n)


def text_columns(df: DataFrame, order: Sequence[str], sample: int = 50) -> DataFrame:
    """``(ordinal, column)`` for each text column, judged on the first rows in one pass."""
    names = [c for c in df.columns if c.strip()]
    head = sample_head(df.select(*names, *(c for c in order if c not in names)), order, sample)

    def is_text(name: str) -> Column:
        value = missing_to_null(F.col(f"`{name}`").cast("string"))
        numeric = F.bool_and(C.is_number_or_null(value))
        boolean = F.bool_and(C.is_boolean_or_null(value))
        return ~(numeric | boolean)

    flags = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("column"), is_text(name).alias("is_text"))
        for i, name in enumerate(names)
    ]
    judged = head.agg(F.array(*flags).alias("c")).select(F.inline("c"))
    return judged.filter("is_text").drop("is_text")


def select_text_columns(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The requested columns that exist, as text; each missing one becomes an error column."""
    from lexiframe.operators.enrich import FAILED

    present = [F.col(c).cast("string").alias(c) for c in cols if c in df.columns]
    missing = [F.lit(FAILED).alias(f"{c}__error") for c in cols if c not in df.columns]
    return df.select(*keep, *present, *missing)
