"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

HEADLINES = (
    "normalize_text",
    "clean_text_ratio",
    "tokenize",
    "pos_string_column",
    "readability",
    "candidate_phrases",
    "keyphrases_column",
    "keyphrases_text",
    "pagerank",
    "analyze_text",
    "enrich_columns",
    "entity_matches",
    "distinct_then_join",
    "validate_files_delimited",
    "assign_chunks",
    "running_error_gate",
    "rate_limit",
)


def laid_out(spark, sf_dir: str, files: int) -> str:
    """The tables as a cluster would hold them: several files each, not one file of one row group."""
    from lexiframe.session import scratch_path

    out = scratch_path(spark, "bench-tables")
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        rows = spark.read.parquet(str(table))
        rows.repartition(files).write.parquet(f"{out}/{table.name}")
    return out


def main() -> None:
    from lexiframe.plans import all_queries
    from lexiframe.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "lexiframe-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, _ = all_queries()
    began = time.time()
    sf_dir, given = laid_out(spark, sf_dir, int(cpus)), sf_dir
    layout_seconds = round(time.time() - began, 3)
    names = sys.argv[1:] or HEADLINES
    # start the workers and load classes once
    registered["normalize_text"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "layout_seconds": layout_seconds,
                "sf": given.rstrip("/").rsplit("sf", 1)[-1],
                "documents": rows,
                "documents_per_sec": {n: round(rows / s, 1) for n, s in seconds.items() if s},
            }
        )
    )


if __name__ == "__main__":
    main()
