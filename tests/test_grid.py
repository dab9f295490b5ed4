from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiframe.functions import cells as C
from lexiframe.operators import grid as G
from lexiframe.sources import scans, sinks

SHEET = [
    [None, "Report 2024"],
    [None, "Id", "Name", "City"],
    [None, "1", "Ann", "Pune"],
    [None, None, None, None],
    [None, "2", "Bo", None],
    [None, "Grand Total", "3", None],
    [None, "3", "Cy", "Goa"],
]


def grid(spark, sheets):
    rows = [(f, i, c) for f, sheet in sheets.items() for i, c in enumerate(sheet)]
    return spark.createDataFrame(rows, "file string, row_idx long, cells array<string>")


@pytest.mark.parametrize(
    "cells, valid",
    [
        (["Id", "Name", "Comment"], True),
        (["PUMP REQUIREMENT", None, None], False),
        (["a", "b"], False),
        (["Total cost of all goods", "Total price of all items", "Other long title text here"], False),
        (["1", "2", "3"], True),
    ],
)
def test_header_predicate(spark, cells, valid):
    row = spark.createDataFrame([(cells,)], "c array<string>")
    assert row.select(C.is_valid_header(F.col("c"))).first()[0] is valid


@pytest.mark.parametrize("flags, valid", [([True, False, False], False), ([True, True, False], True)])
def test_header_predicate_with_types(spark, flags, valid):
    row = spark.createDataFrame([(["x", "1", "2"], flags)], "c array<string>, t array<boolean>")
    assert row.select(C.is_valid_header(F.col("c"), F.col("t"))).first()[0] is valid


def test_sheet_to_table(spark):
    rows = G.extract_rows(grid(spark, {"s": SHEET}))
    table = G.grid_to_table(rows, ["Id", "Name", "City"], ["row_idx"]).orderBy("row_idx")
    assert [tuple(r)[1:] for r in table.collect()] == [("1", "Ann", "Pune"), ("2", "Bo", None)]


def test_header_location(spark):
    found = G.locate_header(grid(spark, {"s": SHEET, "none": [["a", "b"]]})).orderBy("file").collect()
    assert [(r.file, r.header_row, r.start_idx, r.problem) for r in found] == [
        ("none", None, None, "no_valid_header"), ("s", 1, 1, None),
    ]
    unique = G.locate_header(grid(spark, {"s": SHEET}), "unique").first()
    assert unique.problem == "multiple_tables"


def test_split_header(spark):
    rows = spark.createDataFrame(
        [(["A", "", "C"], ["1", "x", "2"]), (["A", "", "C"], ["1", "", "2"]), (["A"], ["1", "x"])],
        "h array<string>, n array<string>",
    )
    got = [r[0] for r in rows.select(C.has_split_headers(F.col("h"), F.col("n"))).collect()]
    assert got == [True, False, True]


def test_equal_names_keep_the_last_cell(spark):
    rows = grid(spark, {"s": [["a", "b", "a"], ["1", "2", "3"]]}).filter("row_idx > 0")
    assert G.grid_to_table(rows, ["a", "b", "a"]).first().asDict() == {"a": "3", "b": "2"}


def test_reports(spark):
    pairs = [["Key", "Of", "Things"]] + [["a", "1", None]] * 9 + [["a", "b", "c"]]
    short = [["Id", "Name", "City"], ["1", "Ann", "Pune"]]
    report = G.validate_files(grid(spark, {"ok": SHEET, "kv": pairs, "short": short}), "csv")
    got = {r.file: (r.status, r.problem, r.columns) for r in report.collect()}
    assert got["kv"] == ("Invalid_file", "key_value_format", None)
    assert got["short"] == ("Invalid_file", "not_enough_rows", None)
    excel = G.validate_files(grid(spark, {"ok": SHEET, "empty": [["Id", "Name", "City"]]}), "excel")
    got = {r.file: (r.status, r.problem, r.columns) for r in excel.collect()}
    assert got["ok"] == ("columns_extracted", None, ["Id", "Name", "City"])
    assert got["empty"][1] == "not_enough_rows"


def test_text_columns_judge_values(spark):
    rows = spark.createDataFrame(
        [
            (1, "1", "true", "x", None, "12d"), (2, "2.5", "False", "2", None, "3f"), (3, "NA", "true", None, None, "4"),
            (4, " -1e3 ", None, None, None, "5"),
        ],
        "i int, n string, b string, t string, e string, code string",
    )
    assert [r.column for r in G.text_columns(rows, ["i"]).collect()] == ["t", "code"]


def test_encodings(spark):
    files = spark.createDataFrame(
        [("u", "café".encode()), ("w", "café".encode("cp1252")), ("l", b"caf\xe9 \x81")],
        "path string, content binary",
    )
    got = {r.path: r.encoding for r in scans.detect_encoding(files).collect()}
    assert got == {"u": "utf-8", "w": "cp1252", "l": "latin1"}


def test_grid_from_bytes(spark):
    wide = ",".join(f"c{i}" for i in range(70))
    content = f'Id,Name\r\n\r\n1,"a, ""b"""\r\n2,\r\n,"two\nlines",""\n   \n{wide}\n5" pipe,x\nlast'.encode()
    files = spark.createDataFrame([("/x/f.csv", content)], "path string, content binary")
    rows = scans.grid_from_files(files).orderBy("row_idx").collect()
    assert [r.cells for r in rows] == [
        ["Id", "Name"], ["1", 'a, "b"'], ["2", None], [None, "two\nlines", ""], wide.split(","), ['5" pipe', "x"], ["last"],
    ]


def test_header_row_and_quoted_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Report,,\nId,,Name \n1,x,"two\nlines"\n2,,NA\n')
    rows = scans.scan_csv(spark, str(tmp_path), header_row=1)
    assert [tuple(r) for r in rows.orderBy("Id").collect()] == [("1", "two\nlines"), ("2", None)]
    with pytest.raises(ValueError):
        scans.scan_csv(spark, str(tmp_path), header_row=9)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.csv").write_text('Id,Name\n1,"two\nlines"\n2,x\n')
    assert scans.scan_csv(spark, str(tmp_path / "b")).count() == 2


def test_append_new_with_null_keys(spark, tmp_path):
    path = str(tmp_path / "out")
    batch = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (1, "d")], "k int, v string")
    for _ in range(3):
        sinks.append_new(batch, path, ["k"])
    got = [(r.k, r.v) for r in spark.read.parquet(path).collect()]
    assert len(got) == 3 and {(None, "b"), (None, "c")} <= set(got)


def test_catalog_takes_each_name_once(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text("a,b\n")
    (tmp_path / "a" / "y.txt").write_text("no")
    found = scans.file_catalog(spark, str(tmp_path)).collect()
    assert [r.name for r in found] == ["x.csv"] and "/a/" in found[0].path
