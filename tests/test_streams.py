from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from lexiframe.functions.normalize import normalize_text
from lexiframe.operators import ratelimit as R
from lexiframe.plans import all_queries
from lexiframe.plans.streams import source
from lexiframe.streaming import streams as S

START = datetime(2024, 1, 1)


def files(spark, df, path, order, parts):
    """One file per slice of time, written in order so that the stream reads them in order."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1)
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_limits_carry_over_micro_batches(spark, tmp_path):
    rng, at, rows = random.Random(1), 0, []
    for i in range(120):
        at += rng.randrange(1, 25)
        rows.append((rng.choice("ab"), START + timedelta(seconds=at), i))
    table = spark.createDataFrame(rows, "client string, ts timestamp, id long")
    source = files(spark, table, str(tmp_path / "in"), "ts", 4)
    out = str(tmp_path / "out")
    writer = S.stream_rate_limit(source, limit=3, ttl_seconds=60).writeStream.format("parquet").option("path", out)
    S.run_to_end(writer.outputMode("append"), str(tmp_path / "state"))
    got = {r.id: r.accepted for r in spark.read.parquet(out).collect()}
    want = {r.id: r.accepted for r in R.rate_limit(table, limit=3, ttl_seconds=60).collect()}
    assert got == want


def test_enrichment_equals_batch(spark, tmp_path):
    table = spark.createDataFrame([(i, f"Row <b>{i}</b> BTW at 1:{i}") for i in range(40)], "id long, text string")
    source = files(spark, table, str(tmp_path / "in"), "id", 3)
    S.stream_enrich(source, ["text"], str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r.t for r in table.select("id", normalize_text(F.col("text")).alias("t")).collect()}
    assert got == want


def test_keys_pass_once(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i), f"k{i % 7}" if i % 3 else None) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, ts timestamp, key string")
    source = files(spark, table, str(tmp_path / "in"), "ts", 3)
    out = str(tmp_path / "out")
    writer = S.stream_dedupe(source, "key", "ts", "1 day").writeStream.format("parquet").option("path", out)
    S.run_to_end(writer.outputMode("append"), str(tmp_path / "state"))
    got = spark.read.parquet(out)
    assert got.filter("key is null").count() == 20
    assert got.filter("key is not null").count() == 7


def test_replay_adds_nothing(spark, tmp_path):
    table = spark.createDataFrame([(i % 30, i) for i in range(50)], "key long, v long")
    source = files(spark, table, str(tmp_path / "in"), "v", 2)
    for run in ("one", "two"):
        S.once_sink(source, str(tmp_path / "out"), ["key"], str(tmp_path / run))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_a_table_may_be_a_file_or_a_folder(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    turns.limit(3).write.parquet(str(tmp_path / "more-conversations.parquet"))
    run = all_queries()[0]["stream_annotate"]
    in_folder, in_file = run(spark, str(tmp_path)), run(spark, sf)
    assert in_folder.count() == turns.count()
    assert not in_folder.exceptAll(in_file.select(in_folder.columns)).count()
    assert source(spark, str(tmp_path), "conversations").isStreaming


def test_a_folder_of_documents_is_normalised_whole(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    run = all_queries()[0]["stream_enrich"]
    assert sorted(run(spark, str(tmp_path)).collect()) == sorted(run(spark, sf).collect())


def test_null_texts_stay_null_as_in_sql(spark, tmp_path):
    texts = [None, "", " ", "A  <b>b</b>", None, "BTW it's www.x.io"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    runs, checks = all_queries()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in runs["stream_enrich"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(checks["stream_enrich"]).fetchall())
    assert [i for i, text in got if text is None] == [0, 4]
