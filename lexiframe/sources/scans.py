"""Reading files: catalog, encodings, delimited files, grids, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiframe.functions.columns import is_one_of
from lexiframe.functions.lexicons import NA_STRINGS

# Accepted file endings, size limit and encodings in order of trial.
ACCEPTED = r"(?i)\.(csv|xlsx)$"
MAX_MB = 100
ENCODINGS = ("utf-8", "cp1252", "latin1")
# Spark's names for them.
CHARSETS = {"utf-8": "UTF-8", "cp1252": "windows-1252", "latin1": "ISO-8859-1"}
# Bytes that mean nothing in cp1252, as latin1 reads them.
CP1252_GAPS = "[\\x{81}\\x{8d}\\x{8f}\\x{90}\\x{9d}]"


def binary_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def file_name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def file_catalog(spark: SparkSession, path: str | Sequence[str], max_mb: int = MAX_MB) -> DataFrame:
    """Acceptable files, each name once. Only listing data is read, never the content."""
    listed = binary_files(spark, path).select("path", "length", "modificationTime")
    named = listed.withColumn("name", file_name())
    kept = named.filter(F.col("name").rlike(ACCEPTED) & (F.col("length") <= max_mb * 1024 * 1024))
    return kept.groupBy("name").agg(
        F.min("path").alias("path"), F.min_by("length", "path").alias("length")
    )


def encoding_of(content: Column) -> Column:
    """The first encoding of the list that can decode the bytes."""
    as_latin1 = F.decode(content, "ISO-8859-1")
    return (
        F.when(F.is_valid_utf8(content), ENCODINGS[0])
        .when(~as_latin1.rlike(CP1252_GAPS), ENCODINGS[1])
        .otherwise(ENCODINGS[2])
    )


def detect_encoding(files: DataFrame) -> DataFrame:
    return files.withColumn("encoding", encoding_of(F.col("content")))


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = "utf-8",
    schema: StructType | str | None = None,
    multi_line: bool = True,
    header_row: int = 0,
) -> DataFrame:
    """Delimited files with a header; the usual texts for missing values become null.

    Without a schema every column is text, the same in every part of the file.
    Quoted line breaks are read, for which a file is one part; files known to hold
    none can be split with ``multi_line=False``. ``header_row`` is the number of the
    row that names the columns, as found in the grid: rows above it are left out,
    in every file, and columns with a blank name too.
    """
    if header_row:
        return under_header(scan_grid(spark, path, encoding), header_row)
    reader = spark.read.options(
        header=True, encoding=CHARSETS[encoding], multiLine=multi_line, escape='"', mode="PERMISSIVE"
    )
    table = reader.schema(schema).csv(path) if schema else reader.csv(path)
    texts = [f.name for f in table.schema if f.dataType.simpleString() == "string"]
    return table.withColumns({name: _known(F.col(f"`{name}`")) for name in texts})


def _known(c: Column) -> Column:
    return F.when(~is_one_of(c, NA_STRINGS), c)


def under_header(grid: DataFrame, header_row: int) -> DataFrame:
    """The rows below the header row as a table; all files must have the same header."""
    headers = grid.filter(F.col("row_idx") == header_row).select("cells").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError("the files have different headers" if headers else "no file has that header row")
    names = [(i, name.strip()) for i, name in enumerate(headers[0].cells) if name and name.strip()]
    rows = grid.filter(F.col("row_idx") > header_row)
    return rows.select(*(_known(F.get("cells", F.lit(i))).alias(name) for i, name in names))


def scan_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def decoded(content: Column, encoding: Column) -> Column:
    """Bytes to text by the encoding found for them."""
    text = F.decode(content, CHARSETS["latin1"])
    for name in ("cp1252", "utf-8"):
        text = F.when(encoding == name, F.decode(content, CHARSETS[name])).otherwise(text)
    return text


# a quoted cell with doubled quotes inside, or anything up to the next comma or line end
CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^,\r\n]*+)'
RECORD = f"{CELL}(?:,{CELL})*+"


def grid_from_files(files: DataFrame, encoding: str | None = None) -> DataFrame:
    """``(file, row_idx, cells)`` from whole small files ``(path, content)``.

    For files within the catalog's size limit. Rows have as many cells as they hold;
    a quoted cell may hold commas, doubled quotes and line breaks. Empty lines do not
    count as rows, empty unquoted cells are null. Without an ``encoding`` each file's
    own is detected.
    """
    chosen = F.lit(encoding) if encoding else encoding_of(F.col("content"))
    text = decoded(F.col("content"), chosen)
    records = F.filter(F.regexp_extract_all(text, F.lit(RECORD), F.lit(0)), lambda r: F.trim(r) != "")
    rows = files.select(file_name().alias("file"), F.posexplode(records).alias("row_idx", "record"))
    return rows.select("file", F.col("row_idx").cast("long").alias("row_idx"), cells_of(F.col("record")).alias("cells"))


def cells_of(record: Column) -> Column:
    """The cells of a record: quotes taken off, empty unquoted cells null."""

    def cell(c: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')
        return F.when(c.startswith('"'), inner).when(c != "", c)

    # a comma in front makes every cell begin with one
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({CELL})"), F.lit(1))
    return F.transform(cells, cell)


def scan_grid(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None) -> DataFrame:
    return grid_from_files(binary_files(spark, path), encoding)
