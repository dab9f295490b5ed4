"""Delimited files of any size, read by ranges.

Spark cuts a file into ranges of whole lines. A quoted cell may hold line breaks, so
whether a line begins a record depends on all lines before it, but only by one bit:
does it begin inside a quoted cell? Each range is read once for both answers, and
says how it would end and how many records it would begin. Composed in order, these
answers tell where every range stands. A second reading cuts the records, all ranges
in parallel; only records that reach over the end of a range are put together by a
shuffle. Encodings are found from the same lines, since no line break lies inside a
character.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.sources import scans

_QUOTED = rb'"[^"]*+(?:""[^"]*+)*+"[^,\r]*+'
_PLAIN = rb'(?!")[^,\r]*+'
#: A line that ends inside a quoted cell.
_OPEN = re.compile(rb'(?:(?:' + _QUOTED + rb'|' + _PLAIN + rb')[,\r])*+"[^"]*+(?:""[^"]*+)*+', re.S)
_CELL = re.compile(_QUOTED + rb"|" + _PLAIN, re.S)


def lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, block, line): the lines of files as bytes, and the place in the file where the range of each begins."""
    text = spark.read.options(lineSep="\n", recursiveFileLookup=True).text(path)
    place = F.col("_metadata.file_block_start")
    return text.select(F.col("_metadata.file_path").alias("path"), place.alias("block"), F.col("value").cast("binary").alias("line"))


# -- encodings -------------------------------------------------------------


def encodings(of: DataFrame, key: str | Column = "path") -> DataFrame:
    """(key, encoding): the first encoding of the list that can decode all lines of a file, or of whatever ``key`` names."""
    key = F.col(key) if isinstance(key, str) else key
    number = {name: k for k, name in enumerate(scans.ENCODINGS)}
    found = F.lit(number["latin1"])
    for name in reversed(scans.ENCODINGS[:-1]):
        found = F.when(scans.encoding_of(F.col("line")) == name, number[name]).otherwise(found)
    worst = of.groupBy(key.alias("key")).agg(F.max(found).alias("worst"))
    return worst.select("key", F.element_at(F.array(*map(F.lit, scans.ENCODINGS)), F.col("worst") + 1).alias("encoding"))


# -- records ---------------------------------------------------------------


def records_of(line: bytes, inside: bool) -> tuple[list[bytes], bool]:
    """The records of a line, and whether the last one goes on in the next line.

    ``inside``: the line begins inside a quoted cell, so its first part belongs to the record before.
    A carriage return outside quotes ends a record, too.
    """
    if b'"' not in line:
        return ([line], True) if inside else (line.split(b"\r"), False)
    body = b'"' + line if inside else line
    if b"\r" not in body:
        return [line], _OPEN.fullmatch(body) is not None
    parts, begin, at, goes_on = [], 0, 0, False
    while True:
        cell = _CELL.match(body, at)
        goes_on = cell is None
        if goes_on or cell.end() == len(body):
            break
        at = cell.end() + 1
        if body[at - 1] == 0x0D:
            parts.append(body[begin : at - 1])
            begin = at
    parts.append(body[begin:])
    if inside:
        parts[0] = parts[0][1:]
    return parts, goes_on


def _blank(record: bytes) -> bool:
    return not record.strip(b" ")


@dataclass
class Passage:
    """What a run of lines does to one state: where it leads, and how many records begin."""

    inside: bool
    records: int = 0

    def take(self, values: pa.Array, quoted: np.ndarray, filled: np.ndarray) -> None:
        """``quoted``: places of lines with a quote or a carriage return; ``filled``: running number of lines with a sign."""
        at = 0
        for k in [*quoted.tolist(), len(values)]:
            if not self.inside:
                self.records += int(filled[k] - filled[at])
            if k == len(values):
                break
            parts, goes_on = records_of(values[k].as_py(), self.inside)
            self.records += sum(not _blank(p) for p in parts[self.inside :])
            self.inside, at = goes_on, k + 1


def _marks(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    odd = pc.or_(pc.match_substring(values, '"'), pc.match_substring(values, "\r"))
    blank = pc.match_substring_regex(values, "^ *$")
    filled = np.concatenate(([0], np.cumsum(~blank.to_numpy(zero_copy_only=False))))
    return np.flatnonzero(odd.to_numpy(zero_copy_only=False)), filled


def _by_range(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The runs of a batch that lie in one range."""
    paths, blocks = batch.column(0), batch.column(1).to_numpy()
    coded = paths.dictionary_encode()
    number = coded.indices.to_numpy()
    starts = np.flatnonzero((np.diff(blocks, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield coded.dictionary[number[a]].as_py(), int(blocks[a]), batch.column(2).slice(a, b - a)


def range_facts(of: DataFrame) -> DataFrame:
    """One row per range: how it ends and how many records it begins, begun outside or inside a quoted cell."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, outside, inside = None, None, None

        def row():
            facts = [[now[0]], [now[1]], [outside.inside], [outside.records], [inside.inside], [inside.records]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in facts], names)

        for batch in batches:
            for path, block, values in _by_range(batch):
                if (path, block) != now:
                    if now:
                        yield row()
                    now, outside, inside = (path, block), Passage(False), Passage(True)
                quoted, filled = _marks(values)
                outside.take(values, quoted, filled)
                inside.take(values, quoted, filled)
        if now:
            yield row()

    names = ["path", "block", "ends_0", "records_0", "ends_1", "records_1"]
    return of.mapInArrow(read, "path string, block long, ends_0 boolean, records_0 long, ends_1 boolean, records_1 long")


def standings(facts: Iterable) -> dict[tuple[str, int], tuple[bool, int]]:
    """(path, block) -> does the range begin inside a cell, and how many records began before it."""
    out = {}
    path, inside, begun = None, False, 0
    for r in sorted(facts, key=lambda r: (r.path, r.block)):
        if r.path != path:
            path, inside, begun = r.path, False, 0
        out[r.path, r.block] = (inside, begun)
        begun += r.records_1 if inside else r.records_0
        inside = r.ends_1 if inside else r.ends_0
    return out


def records(of: DataFrame) -> DataFrame:
    """(path, row_idx, record) of all files, records as bytes. Blank records do not count.

    The table of ranges goes to every task; it has one row for each range that Spark lists for
    the scan. A quote that never closes takes the rest of its file into one cell.
    """
    known = of.sparkSession.sparkContext.broadcast(standings(range_facts(of).collect()))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, number = None, False, 0
        held: list[bytes] = []  # the record that goes on
        reaches = False  # it came from the range before

        def batch_of(rows):
            columns = zip(*rows) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for path, block, values in _by_range(batch):
                rows = []
                if (path, block) != now:
                    if inside:
                        rows.append((now[0], number - 1, now[1], b"\n".join(held)))
                    now = (path, block)
                    if now not in known.value:
                        raise ValueError("the files or their ranges changed while they were read")
                    inside, number = known.value[now]
                    held, reaches = [], inside
                quoted, _ = _marks(values)
                if not len(quoted) and not inside:
                    kept = values.filter(pc.invert(pc.match_substring_regex(values, "^ *$")))
                    rows += [(path, n, None, r) for n, r in enumerate(kept.to_pylist(), number)]
                    number += len(kept)
                    yield batch_of(rows)
                    continue
                for line in values.to_pylist():
                    parts, goes_on = records_of(line, inside)
                    if inside:
                        held.append(parts.pop(0))
                        if goes_on and not parts:
                            continue
                        rows.append((path, number - 1, block if reaches else None, b"\n".join(held)))
                    held, reaches = [parts.pop()] if goes_on else [], False
                    parts = [p for p in parts if not _blank(p)]
                    rows += [(path, n, None, p) for n, p in enumerate(parts, number)]
                    number += len(parts) + goes_on
                    inside = goes_on
                yield batch_of(rows)
        if inside:
            yield batch_of([(now[0], number - 1, now[1], b"\n".join(held))])

    names = ["path", "row_idx", "piece", "record"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    found = of.mapInArrow(cut, "path string, row_idx long, piece long, record binary")
    # records that reach over the end of a range
    pieces = found.filter("piece IS NOT NULL").groupBy("path", "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("piece", "record")))["record"].alias("parts")
    )
    rest = F.slice("parts", 2, F.size("parts"))
    together = F.aggregate(rest, F.get("parts", F.lit(0)), lambda a, b: F.concat(a, F.lit(b"\n"), b))
    whole = found.filter("piece IS NULL").select("path", "row_idx", "record")
    return whole.unionByName(pieces.select("path", "row_idx", together.alias("record")))


# -- grids and tables ------------------------------------------------------


def grid(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None) -> DataFrame:
    """``(file, row_idx, cells)`` like ``scans.scan_grid``, from files of any size.

    Without an ``encoding`` each file's own is detected.
    """
    of = lines(spark, path)
    rows = records(of)
    if encoding is None:
        rows = rows.join(encodings(of).withColumnRenamed("key", "path"), "path")
    text = scans.decoded(F.col("record"), F.lit(encoding) if encoding else F.col("encoding"))
    return rows.select(scans.file_name().alias("file"), "row_idx", scans.cells_of(text).alias("cells"))


def table(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None, header_row: int = 0) -> DataFrame:
    """``scans.scan_csv`` with texts for columns, from files of any size; each range is a task, quoted line breaks or not."""
    return scans.under_header(grid(spark, path, encoding), header_row)
