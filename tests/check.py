"""Run registered queries and their SQL side by side.

    python tests/check.py SF_DIR [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr(tuple(row[i] for i in order)) for row in rows))


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str | None:
    """None when equal, else what differs. Without SQL only that the query runs."""
    df = fn(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 0)
            return f"{sum(x != y for x, y in zip(got, want))} rows differ, e.g.\n  {a[:60]} .. {a[max(at-60,0):at+80]}\n  {b[:60]} .. {b[max(at-60,0):at+80]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from lexiframe.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(sf_dir), 0
    registered, checks = queries(), oracle_sql()
    for name in names or registered:
        began = time.time()
        try:
            problem = compare(spark, con, registered[name], checks.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        kind = "sql " if name in checks else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - began:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main())
