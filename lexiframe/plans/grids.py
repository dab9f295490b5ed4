"""Queries on grids, files, chunks and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import cells as C
from lexiframe.functions.sqlfuncs import register_functions
from lexiframe.operators import chunks as B
from lexiframe.operators import grid as G
from lexiframe.plans import sqltext as S
from lexiframe.plans.registry import query, table
from lexiframe.session import scratch_path
from lexiframe.sources import ranges, scans, sinks

# Customers as sheets of fifty: title, header, rows, a footer and one row after it.
# Every fifth sheet has no header, every fifth another has it split over two rows,
# and every third lists names only.
CELLS = """CASE
    WHEN r = 0 THEN {open}NULL, concat('Report ', CAST(g AS {string})){close}
    WHEN r = 1 AND g % 5 = 0 THEN {open}NULL, 'Id', 'Name'{close}
    WHEN r = 1 AND g % 5 = 1 THEN {open}NULL, 'Id', '', 'Segment', 'Balance'{close}
    WHEN r = 1 THEN {open}NULL, ' Id', 'Name ', 'Segment', 'Balance'{close}
    WHEN r = 9 THEN {open}NULL, NULL, ' ', NULL, ''{close}
    WHEN r = 52 THEN {open}NULL, 'Grand Total', '50'{close}
    WHEN r = 53 THEN {open}NULL, '0', 'after', 'footer', '1'{close}
    WHEN g % 3 = 0 THEN {open}NULL, id, name{close}
    ELSE {open}NULL, id, name, segment, balance{close} END"""
GRID = f"""grid AS (
  SELECT concat('sheet_', CAST(g AS VARCHAR)) AS file, r AS row_idx,
    {CELLS.format(string='VARCHAR', open='[', close=']')} AS cells
  FROM (
    SELECT c_custkey // 50 AS g, c_custkey % 50 + 2 AS r, CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
      c_mktsegment AS segment, CAST(c_acctbal AS VARCHAR) AS balance FROM customer
    UNION ALL
    SELECT c_custkey // 50, unnest([0, 1, 52, 53]), '', '', '', '' FROM customer WHERE c_custkey % 50 = 0))"""


def grid(spark, sf) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.expr("c_custkey div 50").alias("g"),
        (F.col("c_custkey") % 50 + 2).alias("r"),
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("string").alias("balance"),
    )
    extra = customers.filter("r = 2").select(
        "g", F.explode(F.array(*(F.lit(i).cast("long") for i in (0, 1, 52, 53)))).alias("r"),
        *(F.lit("").alias(c) for c in ("id", "name", "segment", "balance")),
    )
    return customers.unionByName(extra).select(
        F.concat(F.lit("sheet_"), F.col("g").cast("string")).alias("file"),
        F.col("r").alias("row_idx"),
        F.expr(CELLS.format(string="STRING", open="array(", close=")")).alias("cells"),
    )


def blank_list(cells: str) -> str:
    return f"list_filter({cells}, lambda c: NOT {S.blank('c')})"


TRIMMED = f"""trimmed AS (
  SELECT *, list_position(list_transform(cells, lambda c: NOT {S.blank('c')}), true) - 1 AS start_idx FROM grid),
tops AS (
  SELECT file, row_idx, start_idx, cells[start_idx + 1:] AS header, {blank_list('cells')} AS filled
  FROM trimmed WHERE start_idx >= 0),
valid AS (
  SELECT *, len(filled) >= 3 AND
    list_sum(list_transform(filled, lambda c: len(string_split({S.collapsed('c')}, ' ')))) <= 3 * len(filled) AS ok
  FROM tops)"""
FIRST = f"""{GRID}, {TRIMMED},
headers AS (
  SELECT f.file, v.row_idx AS header_row, v.start_idx, v.header
  FROM (SELECT DISTINCT file FROM tops) f LEFT JOIN (
    SELECT * FROM valid WHERE ok AND row_idx < 10
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY row_idx) = 1) v USING (file))"""
ROWS = f"""{FIRST},
under AS (
  SELECT g.file, g.row_idx, g.cells[h.start_idx + 1:] AS cells FROM grid g JOIN headers h USING (file)
  WHERE g.row_idx > h.header_row),
footers AS (
  SELECT file, min(row_idx) AS footer_row FROM under
  WHERE regexp_matches(lower(coalesce(list_filter(cells, lambda c: c IS NOT NULL AND c <> '')[1], '')),
    'total|summary|remarks|notes') GROUP BY 1),
cut AS (
  SELECT u.* FROM under u LEFT JOIN footers f USING (file) WHERE f.footer_row IS NULL OR u.row_idx < f.footer_row),
kept AS (SELECT * FROM cut WHERE len({blank_list('cells')}) > 0)"""


def joined(c: str) -> str:
    """An array as one comparable text."""
    return f"array_to_string(list_transform({c}, lambda x: coalesce(x, '~')), '|')"


def joined_cells(name: str = "cells"):
    return F.array_join(F.transform(name, lambda x: F.coalesce(x, F.lit("~"))), "|")


@query(
    "trim_grid",
    f"WITH {GRID}, {TRIMMED} SELECT file, row_idx, CAST(start_idx AS INTEGER) AS start_idx, {joined('header')} AS cells FROM tops",
)
def _(spark, sf):
    return G.trim_grid(grid(spark, sf)).select("file", "row_idx", "start_idx", joined_cells().alias("cells"))


@query(
    "header_predicate",
    f"WITH {GRID}, {TRIMMED} SELECT file, row_idx, ok AS valid FROM valid",
)
def _(spark, sf):
    rows = G.trim_grid(grid(spark, sf))
    return rows.select("file", "row_idx", C.is_valid_header(F.col("cells")).alias("valid"))


@query(
    "header_predicate_in_sql",
    f"WITH {GRID}, {TRIMMED} SELECT file, row_idx, ok AS valid FROM valid",
)
def _(spark, sf):
    """The same test by the function that SQL callers use."""
    register_functions(spark)
    rows = G.trim_grid(grid(spark, sf))
    return rows.select("file", "row_idx", F.expr("coalesce(is_valid_header(cells), false)").alias("valid"))


@query(
    "header_predicate_typed",
    f"""WITH {GRID}, {TRIMMED}, typed AS (
      SELECT *, len(list_filter(filled, lambda c: TRY_CAST(c AS DOUBLE) IS NULL)) AS texts FROM valid)
    SELECT file, row_idx, ok AND texts >= 0.6::DOUBLE * len(filled) AS valid FROM typed""",
)
def _(spark, sf):
    rows = G.trim_grid(grid(spark, sf))
    is_text = F.transform("cells", lambda c: c.try_cast("double").isNull())
    return rows.select("file", "row_idx", C.is_valid_header(F.col("cells"), is_text).alias("valid"))


@query(
    "locate_header_first",
    f"""WITH {FIRST} SELECT file, header_row, CAST(start_idx AS INTEGER) AS start_idx, {joined('header')} AS header,
      CASE WHEN header_row IS NULL THEN 'no_valid_header' END AS problem FROM headers""",
)
def _(spark, sf):
    found = G.locate_header(grid(spark, sf), "first")
    return found.withColumn("header", joined_cells("header"))


@query(
    "locate_header_unique",
    f"""WITH {GRID}, {TRIMMED}, c AS (
      SELECT file, count(*) FILTER (ok) AS n, min(row_idx) FILTER (ok) AS first_at FROM valid WHERE row_idx < 20 GROUP BY 1)
    SELECT file, CASE WHEN n = 1 THEN first_at END AS header_row,
      CASE WHEN n = 0 THEN 'no_table_found' WHEN n > 1 THEN 'multiple_tables' END AS problem FROM c""",
)
def _(spark, sf):
    return G.locate_header(grid(spark, sf), "unique").select("file", "header_row", "problem")


SPLIT = f"""split AS (
  SELECT h.file, coalesce(len(list_filter(range(0, len(n.cells) - h.start_idx), lambda i:
      {S.blank('h.header[i + 1]')} AND NOT {S.blank('n.cells[h.start_idx + i + 1]')})) > 0, false) AS is_split
  FROM headers h LEFT JOIN grid n ON n.file = h.file AND n.row_idx = h.header_row + 1 WHERE h.header_row IS NOT NULL)"""


@query("split_headers", f"WITH {FIRST}, {SPLIT} SELECT * FROM split")
def _(spark, sf):
    rows = grid(spark, sf)
    return G.split_headers(rows, G.locate_header(rows, "first"))


@query(
    "clean_headers",
    f"""WITH {FIRST}
    SELECT file, array_to_string(list_transform({blank_list('header')}, lambda c: trim(c)), '|') AS names
    FROM headers WHERE header_row IS NOT NULL""",
)
def _(spark, sf):
    found = G.locate_header(grid(spark, sf), "first").filter("header_row is not null")
    return found.select("file", F.array_join(C.clean_headers(F.col("header")), "|").alias("names"))


@query("cut_footer", f"WITH {ROWS} SELECT file, row_idx, {joined('cells')} AS cells FROM cut")
def _(spark, sf):
    rows = grid(spark, sf)
    cut = G.cut_footer(G.data_rows(rows, G.locate_header(rows, "first")))
    return cut.select("file", "row_idx", joined_cells().alias("cells"))


@query("drop_blank_rows", f"WITH {ROWS} SELECT file, row_idx, {joined('cells')} AS cells FROM kept")
def _(spark, sf):
    kept = G.extract_rows(grid(spark, sf))
    return kept.select("file", "row_idx", joined_cells().alias("cells"))


@query(
    "drop_blank_rows_delimited",
    f"""WITH {GRID} SELECT file, row_idx FROM grid
    WHERE cells[2] IS NULL OR NOT {S.blank('cells[2]')}""",
)
def _(spark, sf):
    rows = grid(spark, sf).withColumn("cells", F.slice("cells", 2, 99))
    return G.drop_blank_rows(rows, "csv").select("file", "row_idx")


@query(
    "grid_to_table",
    f"""WITH {ROWS} SELECT file, row_idx, cells[1] AS Id, cells[2] AS Name, cells[3] AS Segment, cells[4] AS Balance
    FROM kept JOIN headers USING (file) WHERE trim(header[2]) = 'Name' AND len(header) = 4""",
)
def _(spark, sf):
    rows = grid(spark, sf)
    headers = G.locate_header(rows, "first").filter("trim(header[1]) = 'Name' and size(header) = 4")
    kept = G.drop_blank_rows(G.cut_footer(G.data_rows(rows, headers)))
    return G.grid_to_table(kept, ["Id", "Name", "Segment", "Balance"], ["file", "row_idx"])


@query(
    "table_cells",
    f"""WITH {ROWS}, slots AS (
      SELECT file, trim(unnest(header)) AS col, generate_subscripts(header, 1) AS i FROM headers WHERE header_row IS NOT NULL)
    SELECT k.file, k.row_idx, s.col AS "column", k.cells[s.i] AS value FROM kept k JOIN slots s USING (file) WHERE s.col <> ''""",
)
def _(spark, sf):
    rows = grid(spark, sf)
    return G.table_cells(G.extract_rows(rows), G.locate_header(rows))


GATES = f"""{FIRST},
heads AS (
  SELECT h.file, g.row_idx - h.header_row AS nr, len(h.header) AS width,
    len({blank_list('g.cells[h.start_idx + 1:]')}) AS full_cells, g.cells[h.start_idx + 1:] AS cells
  FROM headers h JOIN grid g ON g.file = h.file AND g.row_idx > h.header_row AND g.row_idx <= h.header_row + 50),
gates AS (
  SELECT file,
    count(*) FILTER (nr <= 20 AND full_cells <= 2) > 0.7::DOUBLE * count(*) FILTER (nr <= 20) AS key_value,
    count(*) FILTER (full_cells >= 0.5::DOUBLE * width) >= 0.6::DOUBLE * count(*) AS structured,
    count(*) FILTER (cells[1] IS NULL OR NOT {S.blank('cells[1]')}) AS data_rows
  FROM heads GROUP BY 1)"""


@query("structure_gates", f"WITH {GATES} SELECT file, key_value, structured, CAST(data_rows AS INTEGER) AS data_rows FROM gates")
def _(spark, sf):
    rows = grid(spark, sf)
    checked = G.gate_values(G.sample_rows(rows, G.locate_header(rows, "first")))
    return checked.select("file", "key_value", "structured", "data_rows")


@query(
    "validate_files_delimited",
    f"""WITH {GATES}, cellwise AS (
      SELECT x.file, i, trim(h.header[i]) AS name, x.cells[i] AS v FROM (
        SELECT file, cells, unnest([1, 2, 3, 4]) AS i FROM heads
        WHERE cells[1] IS NULL OR NOT {S.blank('cells[1]')}) x JOIN headers h USING (file)
      WHERE i <= len(h.header) AND trim(h.header[i]) <> ''),
    texts AS (
      SELECT file, i, name FROM cellwise GROUP BY 1, 2, 3
      HAVING bool_or(v IS NOT NULL AND v NOT IN {S.listed(G.NA_STRINGS)} AND TRY_CAST(v AS DOUBLE) IS NULL)),
    named AS (SELECT file, string_agg(name, '|' ORDER BY i) AS names FROM texts GROUP BY 1)
    SELECT h.file, CASE WHEN problem IS NOT NULL THEN 'Invalid_file' WHEN names IS NULL THEN 'no_columns_found'
        ELSE 'columns_extracted' END AS status, problem, CASE WHEN problem IS NULL THEN coalesce(names, '') END AS columns
    FROM (SELECT h.file, CASE WHEN h.header_row IS NULL THEN 'no_valid_header' WHEN key_value THEN 'key_value_format'
        WHEN NOT structured THEN 'not_structured' WHEN data_rows < 2 THEN 'not_enough_rows' END AS problem
      FROM headers h LEFT JOIN gates USING (file)) h LEFT JOIN named USING (file)""",
)
def _(spark, sf):
    report = G.validate_files(grid(spark, sf), "csv")
    return report.withColumn("columns", F.array_join("columns", "|"))


@query(
    "validate_files_spreadsheet",
    f"""WITH {ROWS}, {SPLIT}, n AS (SELECT file, count(*) AS n FROM kept GROUP BY 1)
    SELECT h.file, CASE WHEN problem IS NULL THEN 'columns_extracted' ELSE 'Invalid_file' END AS status, problem,
      CASE WHEN problem IS NULL THEN array_to_string(list_transform({blank_list('header')}, lambda c: trim(c)), '|') END AS columns
    FROM (SELECT h.*, CASE WHEN header_row IS NULL THEN 'no_valid_header' WHEN is_split THEN 'split_header'
        WHEN n IS NULL THEN 'not_enough_rows' END AS problem
      FROM headers h LEFT JOIN split USING (file) LEFT JOIN n USING (file)) h""",
)
def _(spark, sf):
    report = G.validate_files(grid(spark, sf), "excel")
    return report.withColumn("columns", F.array_join("columns", "|"))


@query(
    "minimum_rows",
    "SELECT c_mktsegment AS file, count(*) >= 2 AS enough FROM customer GROUP BY 1",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "file")
    return G.enough_rows(rows)


@query(
    "text_columns",
    f"""WITH heads AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 50),
    long AS (SELECT unnest([0, 1, 2, 3, 4]) AS ordinal,
      unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS "column",
      unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment]) AS v FROM heads)
    SELECT ordinal, "column" FROM long GROUP BY 1, 2
    HAVING NOT bool_and(v IS NULL OR TRY_CAST(v AS DOUBLE) IS NOT NULL) AND NOT bool_and(lower(v) IN ('true', 'false'))""",
)
def _(spark, sf):
    return G.text_columns(table(spark, sf, "customer"), ["c_custkey"])


@query(
    "select_text_columns",
    "SELECT o_orderkey, o_orderpriority, o_orderstatus, 'Processing failed' AS absent__error FROM orders",
)
def _(spark, sf):
    return G.select_text_columns(
        table(spark, sf, "orders"), ["o_orderpriority", "absent", "o_orderstatus"], ["o_orderkey"]
    )


@query("sample_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def _(spark, sf):
    return G.sample_head(table(spark, sf, "orders"), ["o_orderkey"], 50).select("o_orderkey", "o_custkey")


@query(
    "assign_chunks",
    """SELECT o_orderkey, CAST((n - 1) // 500 + 1 AS INTEGER) AS chunk_no,
      'orders_chunk_' || ((n - 1) // 500 + 1) || '_csv' AS chunk_id
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("job", F.lit("orders"))
    return B.assign_chunks(orders, ["job"], ["o_orderkey"], job="job", rows_per_block=2000).select(
        "o_orderkey", "chunk_no", "chunk_id"
    )


@query(
    "assign_batches",
    """SELECT l_orderkey, l_linenumber, CAST((n - 1) // 5 AS INTEGER) AS batch_no FROM (
      SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS n
      FROM lineitem)""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    batched = B.assign_batches(
        lines, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"], rows_per_block=5000
    )
    return batched.select("l_orderkey", "l_linenumber", "batch_no")


@query(
    "content_keys",
    """SELECT o_orderkey, md5('job_chunk_' || o_orderkey || '_csv') AS chunk_key FROM orders""",
)
def _(spark, sf):
    chunk = F.concat(F.lit("job_chunk_"), F.col("o_orderkey").cast("string"), F.lit("_csv"))
    return table(spark, sf, "orders").select("o_orderkey", B.content_key(chunk).alias("chunk_key"))


@query(
    "batch_keys",
    """SELECT l_orderkey, md5(string_agg(k, '' ORDER BY k)) AS partial_key,
      md5(l_orderkey || '_' || string_agg(k, '|' ORDER BY k)) AS final_key
    FROM (SELECT DISTINCT l_orderkey, md5(l_orderkey || '-' || l_linenumber) AS k FROM lineitem) GROUP BY l_orderkey""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    key = F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    keyed = lines.groupBy("l_orderkey").agg(F.collect_set(key).alias("k"))
    return keyed.select(
        "l_orderkey",
        B.batch_key(F.col("k")).alias("partial_key"),
        B.final_key(F.col("l_orderkey"), F.col("k")).alias("final_key"),
    )


# --- sources and sinks -----------------------------------------------------


@query("scan_parquet", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(spark, sf):
    return scans.scan_parquet(spark, f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")


@query("write_parquet", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "customers")
    sinks.write_parquet(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.parquet(path)


@query(
    "concat_tables",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    parts = [orders.filter(F.col("o_orderstatus") == s) for s in ("F", "O")]
    rest = orders.filter(~F.col("o_orderstatus").isin("F", "O"))
    return sinks.concat_tables([*parts, rest])


@query(
    "export_csv",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, text || ' \"q\", x' AS text FROM documents",
)
def _(spark, sf):
    path = scratch_path(spark, "export")
    docs = table(spark, sf, "documents").select("doc_id", "source", F.concat("text", F.lit(' "q", x')).alias("text"))
    sinks.export_csv(docs, path)
    return scans.scan_csv(spark, path)


@query(
    "scan_csv_header_row",
    """SELECT c_custkey::VARCHAR AS Id, c_name || chr(10) || '"x"' AS Name, c_mktsegment AS Segment FROM customer""",
)
def _(spark, sf):
    path = scratch_path(spark, "header-row")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").coalesce(2)
    quoted = F.concat(F.lit('"'), F.col("c_name"), F.lit('\n""x"""'))
    line = F.concat_ws(",", "c_custkey", F.lit(""), quoted, "c_mktsegment")
    title = "Customers,,,\nId,,Name , Segment\n"
    whole = customers.groupBy(F.spark_partition_id()).agg(F.concat(F.lit(title), F.concat_ws("\n", F.collect_list(line))).alias("value"))
    whole.select("value").write.option("lineSep", "\n").text(path)
    return scans.scan_csv(spark, f"{path}/*.txt", header_row=1)


@query(
    "scan_csv",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
      CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS segment FROM customer""",
)
def _(spark, sf):
    path = scratch_path(spark, "csv")
    segment = F.when(F.col("c_mktsegment") == "MACHINERY", "N/A").otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", segment.alias("segment"))
    sinks.export_csv(rows, path, compress=False)
    return scans.scan_csv(spark, path)


@query(
    "scan_csv_cp1252",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents",
)
def _(spark, sf):
    path = scratch_path(spark, "cp1252")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.write.options(header=True, quoteAll=True, escape='"', encoding="windows-1252").csv(path)
    return scans.scan_csv(spark, path, "cp1252")


def _encoded_files(spark, sf) -> str:
    """The documents as files in three encodings, one folder each, as many files as the table has parts."""
    path = scratch_path(spark, "encodings")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("Id"), F.concat(F.lit("é "), "text").alias("Text"), F.col("source").alias("Source")
    )
    for name, charset in scans.CHARSETS.items():
        tail = "\x81" if name == "latin1" else ""
        out = rows.withColumn("Text", F.concat("Text", F.lit(tail)))
        out.write.options(header=True, quoteAll=True, escape='"', encoding=charset).csv(f"{path}/{name}")
    return path


#: Orders that a catalog file holds, so that none outgrows the catalog's limit.
ORDERS_A_FILE = 250_000


def folder() -> Column:
    return F.element_at(F.split("path", "/"), -2)


ENCODED = """stored AS (SELECT unnest(['utf-8', 'cp1252', 'latin1']) AS stored),
  bytes AS (SELECT stored, bool_or(stored <> 'utf-8' AND text <> '') AS broken, bool_or(stored = 'latin1') AS gaps
    FROM documents, stored GROUP BY 1),
  found AS (SELECT stored, CASE WHEN NOT broken THEN 'utf-8' WHEN NOT gaps THEN 'cp1252' ELSE 'latin1' END AS encoding FROM bytes)"""


@query("detect_encoding", f"WITH {ENCODED} SELECT stored, encoding FROM found")
def _(spark, sf):
    lines = ranges.lines(spark, f"{_encoded_files(spark, sf)}/*/*.csv")
    return ranges.encodings(lines, folder()).select(F.col("key").alias("stored"), "encoding")


@query(
    "validate_with_encoding",
    f"WITH {ENCODED} SELECT 'columns_extracted' AS status, 'Text|Source' AS columns, encoding FROM found WHERE EXISTS (FROM documents)",
)
def _(spark, sf):
    """A folder's files are one table: its encoding goes for each of them."""
    path = f"{_encoded_files(spark, sf)}/*/*.csv"
    lines = ranges.lines(spark, path)
    named = F.concat_ws("/", folder(), scans.file_name())
    rows = ranges.records(lines).join(ranges.encodings(lines, folder()), folder() == F.col("key"))
    cells = scans.cells_of(scans.decoded(F.col("record"), F.col("encoding")))
    grid = rows.select(named.alias("file"), "row_idx", cells.alias("cells"))
    encodings = rows.select(named.alias("file"), "encoding").distinct()
    report = G.validate_files(grid, encodings=encodings)
    return report.select("status", F.array_join("columns", "|").alias("columns"), "encoding").distinct()


@query(
    "scan_grid_by_ranges",
    """SELECT doc_id || '|' || coalesce(text, '~') || ' "q", x' || chr(10) || 'y|' || coalesce(source, '~') AS cells FROM documents""",
)
def _(spark, sf):
    path = scratch_path(spark, "grid-ranges")
    text = F.concat(F.coalesce("text", F.lit("~")), F.lit(' "q", x\ny'))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("Id"), text.alias("Text"), F.coalesce("source", F.lit("~")).alias("Source"))
    rows.write.options(header=True, escape='"').csv(path)
    found = ranges.grid(spark, f"{path}/*.csv", "utf-8").filter("row_idx > 0")
    return found.select(F.array_join("cells", "|").alias("cells"))


@query(
    "scan_csv_by_ranges",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text || chr(10) || source AS value FROM documents",
)
def _(spark, sf):
    path = scratch_path(spark, "csv-ranges")
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit("\n"), "source").alias("value"))
    docs.write.options(header=True, quoteAll=True, escape='"', encoding="windows-1252").csv(path)
    return ranges.table(spark, f"{path}/*.csv", "cp1252")


@query(
    "file_catalog",
    f"""SELECT DISTINCT 'orders_' || o_orderpriority[1] || '_' || (o_orderkey // {ORDERS_A_FILE}) || '.csv' AS name, true AS filled
      FROM orders""",
)
def _(spark, sf):
    """Named files of bounded size, each twice under other folders, beside files that the catalog does not accept."""
    path = scratch_path(spark, "catalog")
    part = F.floor(F.col("o_orderkey") / ORDERS_A_FILE).cast("long")
    rows = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p"), part.alias("part"))
    for place, ending in (("a", "csv"), ("b", "csv"), ("c", "txt")):
        written = scratch_path(spark, "catalog-part")
        rows.repartition("p", "part").write.partitionBy("p", "part").csv(written)
        for r in rows.select("p", "part").distinct().collect():  # one row per file
            _moved(spark, f"{written}/p={r.p}/part={r.part}", f"{path}/{place}/orders_{r.p}_{r.part}.{ending}")
    found = scans.file_catalog(spark, path)
    return found.select("name", (F.col("length") > 0).alias("filled"))


def _moved(spark, folder: str, target: str) -> None:
    """Give the one file of a written folder a name of its own."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(hadoop.Path(folder)) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(hadoop.Path(target).getParent())
    fs.rename(part, hadoop.Path(target))


@query(
    "scan_grid",
    """SELECT c_custkey || '|' || c_name || ', "x"|~|' || c_nationkey AS cells FROM customer""",
)
def _(spark, sf):
    path = scratch_path(spark, "grid")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Id"),
        F.concat("c_name", F.lit(', "x"')).alias("Name"),
        F.lit(None).cast("string").alias("Note"),
        F.col("c_nationkey").alias("Region"),
    )
    rows.write.options(header=True, escape='"').csv(path)
    found = scans.scan_grid(spark, path).filter(F.col("file").endswith(".csv"))
    return found.filter("row_idx > 0").select(joined_cells().alias("cells"))


@query(
    "write_once",
    "SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 13",
)
def _(spark, sf):
    path = scratch_path(spark, "once")
    customers = table(spark, sf, "customer")
    sinks.write_once(customers.filter("c_nationkey < 13").select("c_custkey", "c_name"), path)
    sinks.write_once(customers.select("c_custkey", "c_name"), path)
    return spark.read.parquet(path)


@query(
    "append_new_keys",
    "SELECT CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS c_custkey, c_name FROM customer",
)
def _(spark, sf):
    path = scratch_path(spark, "append")
    key = F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("c_custkey")
    customers = table(spark, sf, "customer").select(key, "c_name")
    sinks.append_new(customers.filter("c_custkey % 3 = 0 OR c_custkey IS NULL"), path, ["c_custkey"])
    sinks.append_new(customers, path, ["c_custkey"])
    sinks.append_new(customers, path, ["c_custkey"])
    return spark.read.parquet(path)


@query(
    "missing_keys",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def _(spark, sf):
    written = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey")
    )
    return sinks.new_rows(table(spark, sf, "orders").select("o_orderkey"), written, ["o_orderkey"])
