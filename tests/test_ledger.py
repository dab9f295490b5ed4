from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexiframe.operators import chunks as B
from lexiframe.operators import ledger as J
from lexiframe.operators import ratelimit as R
from lexiframe.operators import skew as S
from lexiframe.sources import sinks

START = datetime(2024, 1, 1)


def statuses(spark, jobs):
    rows = [(j, i, s) for j, listed in jobs.items() for i, s in enumerate(listed)]
    return spark.createDataFrame(rows, "job_id string, seq long, status string")


def test_gate(spark):
    log = statuses(spark, {"a": ["success", "failed", "empty", "success"], "b": ["success", "failed", "failed"]})
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    got = {r.job_id: (r.error, r.status) for r in J.failure_gate(log, jobs=jobs).collect()}
    assert got == {
        "a": (None, None),
        "b": ("TooManyFailedChunks", "Aggregation_Failed"),
        "c": ("NoValidChunks", "Aggregation_Failed"),
    }


def test_running_gate(spark):
    flags = [False, True, True, True, False, True]
    log = spark.createDataFrame([("j", i + 1, f) for i, f in enumerate(flags)], "job_id string, seq long, failed boolean")
    assert J.running_error_gate(log).first().stopped_at == 6


def test_chunk_numbers(spark):
    rows = spark.range(1001).withColumn("job", F.lit("j"))
    got = B.assign_chunks(rows, ["job"], ["id"], job="job", rows_per_block=64)
    counts = {r.chunk_no: r["count"] for r in got.groupBy("chunk_no").count().collect()}
    assert counts == {1: 500, 2: 500, 3: 1}
    assert got.filter("id = 1000").first().chunk_id == "j_chunk_3_csv"


@pytest.mark.parametrize("rows_per_block", [10**6, 40, 7])
@pytest.mark.parametrize("clustered", [False, True])
def test_running_values_against_brute_force(spark, rows_per_block, clustered):
    """Also with one key holding most rows, and with nearly equal first order values."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        at = (1 if rng.random() < 0.9 else rng.randrange(10**6)) if clustered else rng.randrange(10**6)
        rows.append(("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", at, i, rng.randrange(3)))
    df = spark.createDataFrame(rows, "k string, at long, id long, v int")
    got = S.running_sum(df, ["k"], ["at", "id"], {"total": F.col("v")}, rows_per_block)
    seen = S.previous_value(df, ["k"], ["at", "id"], "v", "before", rows_per_block)
    sums, last, want, prev = {}, {}, {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        prev[i], last[k] = last.get(k), v
        want[i] = sums[k] = sums.get(k, 0) + v
    assert {r.id: r.total for r in got.collect()} == want
    assert {r.id: r.before for r in seen.collect()} == prev


def test_small_blocks_of_many_rows_stay_few_ranges(spark, monkeypatch):
    """A range is a task: their number must not follow the rows, however small the blocks asked for."""
    monkeypatch.setattr(S, "MOST_RANGES", 5)
    df = spark.range(600).select(F.lit("k").alias("k"), F.lit(1).alias("at"), "id")
    assert S.with_block(df, ["k"], ["at", "id"], 10).select("__block").distinct().count() <= 6
    sums = S.running_sum(df, ["k"], ["at", "id"], {"total": F.col("id")}, 10)
    assert {r.id: r.total for r in sums.collect()} == {i: i * (i + 1) // 2 for i in range(600)}
    seen = S.previous_value(df, ["k"], ["at", "id"], "id", "before", 10)
    assert {r.id: r.before for r in seen.collect()} == {i: i - 1 if i else None for i in range(600)}


def test_file_gate_is_tested_after_good_groups_only(spark):
    logs = {"all_bad": [True] * 4, "late": [True, True, True, False, False], "fine": [False, True, False]}
    rows = [(f, i, x) for f, listed in logs.items() for i, x in enumerate(listed)]
    log = spark.createDataFrame(rows, "file string, seq long, failed boolean")
    got = {r.file: (r.groups, r.stopped_at, r.written) for r in J.file_error_gate(log).collect()}
    assert got == {"all_bad": (4, None, 0), "late": (5, 3, 1), "fine": (3, None, 2)}


@pytest.mark.parametrize("seconds, minutes", [(90, 1.5), (100, 1.67), (7.5, 0.12)])
def test_duration(spark, seconds, minutes):
    rows = spark.createDataFrame(
        [(START, START + timedelta(seconds=seconds))], "created_at timestamp, completed_at timestamp"
    )
    assert J.job_duration(rows).first().total_time_taken == minutes


def test_progress_reports_every_fifth_distinct_key(spark):
    rows = [("j", i, "success", f"k{i // 2}") for i in range(24)]
    log = spark.createDataFrame(rows, "job_id string, seq long, status string, key string")
    assert [(r.processed, r.seq) for r in J.progress(log).orderBy("seq").collect()] == [(5, 8), (10, 18)]


def requests(spark, rows):
    return spark.createDataFrame(
        [(c, START + timedelta(seconds=s), i) for i, (c, s) in enumerate(rows)], "client string, ts timestamp, id long"
    )


def test_rate_limit(spark):
    rows = requests(spark, [("a", s) for s in (0, 10, 20, 30, 79, 80, 81, 82)])
    got = R.rate_limit(rows, limit=3, ttl_seconds=60).orderBy("id").collect()
    assert [r.accepted for r in got] == [True, True, True, False, False, True, True, True]


def slow_limit(rows, limit, ttl):
    state, accepted = {}, {}
    for i, (client, at) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        n, until = state.get(client, (0, -1))
        n = n if at < until else 0
        accepted[i] = n < limit
        if n < limit:
            state[client] = (n + 1, at + ttl)
    return accepted


@pytest.mark.parametrize("gap", [1, 12, 25, 70, 400])
def test_rate_limit_against_brute_force(spark, gap):
    """Clients without any pause, with some, with many."""
    rng = random.Random(gap)
    at, rows = 0, []
    for _ in range(400):
        at += rng.randrange(1, 2 * gap + 1)
        rows.append((rng.choice(["busy", "busy", "calm"]), at))
    got = {r.id: r.accepted for r in R.rate_limit(requests(spark, rows), limit=4, ttl_seconds=60).collect()}
    assert got == slow_limit(rows, 4, 60)


def test_idempotent_requests(spark):
    rows = spark.createDataFrame(
        [(1, 5, "a"), (2, 3, "a"), (3, 1, None), (4, 2, None), (5, 9, "b")], "id int, ts int, idempotency_key string"
    )
    assert sorted(r.id for r in J.dedupe_idempotent(rows).collect()) == [2, 3, 4, 5]


def test_status_changes(spark):
    rows = [("j", i, s) for i, s in enumerate("aabbba")]
    log = spark.createDataFrame(rows, "job_id string, ts long, status string")
    got = J.status_changes(log).orderBy("ts").collect()
    assert [(r.ts, r.status, r.previous) for r in got] == [(0, "a", None), (2, "b", "a"), (5, "a", "b")]


def test_facts_reach_every_row_of_a_hot_key(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise("cold").alias("k"))
    facts = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, f int")
    for joined in (S.hot_join(rows, facts, ["k"], ["id"]), S.hot_join(rows, facts, ["k"], ["id"], hot_rows=100)):
        assert {(r.k, r.f, r["count"]) for r in joined.groupBy("k", "f").count().collect()} == {
            ("hot", 1, 900), ("cold", 2, 100),
        }


def test_concat_wants_equal_schemas(spark):
    one, two = spark.range(2), spark.range(2).select(F.col("id").cast("string").alias("id"))
    assert sinks.concat_tables([one, one]).count() == 4
    with pytest.raises(ValueError, match="schema of table 1"):
        sinks.concat_tables([one, two])


def test_no_chunks_no_rows(spark):
    empty = spark.createDataFrame([], "job_id string, seq long, status string")
    assert J.chunk_summary(empty).count() == 0
    assert J.status_changes(empty.withColumnRenamed("seq", "ts")).count() == 0


@pytest.mark.parametrize("rows_per_block", [1, 2, 10**9])
def test_nulls_in_key_and_order(spark, rows_per_block):
    rows = [(k, o, v) for v, (k, o) in enumerate([("a", 1), ("a", None), (None, 3), (None, None), ("a", 9), (None, 50), ("b", None)])]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    sums = S.running_sum(df, ["k"], ["o", "v"], {"s": F.col("v")}, rows_per_block=rows_per_block)
    assert {r.v: r.s for r in sums.collect()} == {0: 1, 1: 1, 2: 5, 3: 3, 4: 5, 5: 10, 6: 6}
    before = S.previous_value(df, ["k"], ["o", "v"], "v", "p", rows_per_block=rows_per_block)
    assert {r.v: r.p for r in before.collect()} == {0: 1, 1: None, 2: 3, 3: None, 4: 0, 5: 2, 6: None}
