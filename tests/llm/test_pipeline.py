from __future__ import annotations

import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import plain
import pytest
from check import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from lexiframe.llm import plans

ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.mark.parametrize("name", sorted(plans.CHECKS))
def test_query(spark, sf, name):
    assert compare(spark, duck(sf), plans.QUERIES[name], plans.CHECKS[name], sf) is None


def test_all_are_registered():
    numbers = {n.split("_")[0] for n in plans.QUERIES if n != "pipeline"}
    assert numbers == {f"op{k}" for k in range(1, 14)} and "pipeline" in plans.QUERIES


def test_stages(spark, sf, tmp_path):
    """Every stage against the plain version of its operator."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept.append((docs, spark.read.parquet(path)))
        docs = kept[-1][1]
        assert name == "shard" or docs.columns == columns
    (raw, good), (_, single), (_, clean), (_, mix), (_, sharded) = kept

    scored = plans.quality.quality_scores(raw, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rows(good) == rows(raw.join(scored.filter("predicted = 1"), "doc_id", "left_semi").select(*columns))

    pairs = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c, _ in plain.near_classes(pairs)})

    pairs = [(r.doc_id, r.text) for r in single.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(c[0] for c in plain.contamination(pairs, items) if not c[-1])

    clean.createOrReplaceTempView("clean")
    con = duck(sf)
    con.register("clean", clean.toPandas())
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({plans.mix_sql('clean')})").fetchall() if r[1]}
    assert Counter(r.doc_id for r in mix.collect()) == want

    assert rows(sharded.select(*columns)) == rows(mix)
    load = [r.bytes for r in sharded.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    longest = sharded.agg(F.max("size")).first()[0]
    assert max(load) - min(load) <= longest


def rows(df):
    return sorted(map(str, df.collect()))


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "shard", "virtual_slot"} <= set(out.columns)


def test_without_this_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1') for n in q)"],
        cwd=copy, capture_output=True, text=True,
    )
    assert said.returncode == 0, said.stderr
