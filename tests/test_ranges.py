from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiframe.sources import ranges as R
from lexiframe.sources import scans

PLAIN = b"Id,Name\n1,Ann\n\n  \n2,Bo\n3,\n"
QUOTED = b'Id,Name\n1,"a\nb"\n2,"say ""hi"",\nthere\n\n"\n3,5" pipe\n"4","x"y\n"","\n"\n'
CRLF = b'Id,Name\r\n1,"a\r\nb"\r\n\r\n2,c\r\n'
MAC = b'Id,Name\r1,"a\rb"\r2,"c\nd"\r\r3,e'
FILES = {"plain.csv": PLAIN, "quoted.csv": QUOTED, "crlf.csv": CRLF, "mac.csv": MAC, "empty.csv": b"", "blank.csv": b"\n\n \n"}


def made(rng, rows):
    cells = ["a", "", '"q"', '"x\ny"', '"1,2"', '"say ""no"" \n\n"', "b c", '""', ' "', 'd"e', "é"]
    return "\n".join(",".join(rng.choices(cells, k=rng.randint(1, 4))) for _ in range(rows)).encode()


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def to(size):
        for name, value in zip(names, (f"{size}b", "0b", "1")):
            spark.conf.set(name, value)

    yield to
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rows_of(grid):
    return sorted((r.file, r.row_idx, r.cells) for r in grid.collect())


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_as_whole_files(spark, tmp_path, small_ranges, size):
    rng = random.Random(1)
    files = {**FILES, **{f"made{k}.csv": made(rng, 40) for k in range(4)}}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    small_ranges(size)
    path = str(tmp_path)
    assert rows_of(R.grid(spark, path)) == rows_of(scans.scan_grid(spark, path))
    if size == 7:
        facts = R.range_facts(R.lines(spark, path)).collect()
        assert len({r.block for r in facts if r.path.endswith("quoted.csv")}) > 4
        assert any(inside for inside, _ in R.standings(facts).values())


def test_records_of():
    assert R.records_of(b"a,b", False) == ([b"a,b"], False)
    assert R.records_of(b'a,"b', False) == ([b'a,"b'], True)
    assert R.records_of(b"still", True) == ([b"still"], True)
    assert R.records_of(b'end",c', True) == ([b'end",c'], False)
    assert R.records_of(b'end",c\rd,"e', True) == ([b'end",c', b'd,"e'], True)
    assert R.records_of(b'x 5" y', False) == ([b'x 5" y'], False)
    assert R.records_of(b'""', True) == ([b'""'], True)
    assert R.records_of(b'"', True) == ([b'"'], False)


def test_passages_compose():
    """What two runs of lines do one after the other is what they do together, from either state."""
    import pyarrow as pa

    rng = random.Random(2)
    for _ in range(50):
        text = made(rng, 12).split(b"\n")
        cut = rng.randrange(len(text) + 1)
        for inside in (False, True):
            whole, parts = R.Passage(inside), R.Passage(inside)
            for passage, runs in ((whole, [text]), (parts, [text[:cut], text[cut:]])):
                for run in runs:
                    values = pa.array(run, pa.binary())
                    passage.take(values, *R._marks(values))
            assert whole == parts


def test_open_to_the_end(spark, tmp_path, small_ranges):
    (tmp_path / "open.csv").write_bytes(b'Id\n1\n"never\ncloses\nat all\n')
    small_ranges(6)
    got = [r.record for r in R.records(R.lines(spark, str(tmp_path))).orderBy("row_idx").collect()]
    assert [bytes(r) for r in got] == [b"Id", b"1", b'"never\ncloses\nat all']


def test_encodings(spark, tmp_path, small_ranges):
    texts = {"utf.csv": "é 日本\nx".encode(), "cp.csv": "a\nb\né €".encode("cp1252"), "latin.csv": b"a\xe9\n\x81", "ascii.csv": b"abc\n" * 9}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    for size in (4, 1 << 20):
        small_ranges(size)
        found = R.encodings(R.lines(spark, str(tmp_path)))
        got = {r.key.rsplit("/", 1)[1]: r.encoding for r in found.collect()}
        assert got == {"utf.csv": "utf-8", "cp.csv": "cp1252", "latin.csv": "latin1", "ascii.csv": "utf-8"}
        whole = scans.detect_encoding(scans.binary_files(spark, str(tmp_path)))
        assert {r.path.rsplit("/", 1)[1]: r.encoding for r in whole.collect()} == got


def test_table(spark, tmp_path, small_ranges):
    (tmp_path / "t.csv").write_bytes("Title,,\nId,,Name\n1,x,é\n2,,N/A\n3,,\"a\nb\"\n".encode("cp1252"))
    small_ranges(9)
    rows = R.table(spark, str(tmp_path), header_row=1).orderBy("Id").collect()
    assert [tuple(r) for r in rows] == [("1", "é"), ("2", None), ("3", "a\nb")]
    assert R.records(R.lines(spark, str(tmp_path))).filter(F.lit(False)).count() == 0
