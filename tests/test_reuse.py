from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiframe.operators.reuse import KEY, TextStore

SCHEMA = "n int, upper string"


@pytest.fixture()
def store(spark, tmp_path):
    return TextStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4)


def counting(spark):
    seen = spark.sparkContext.accumulator(0)

    def fn(texts):
        seen.add(texts.count())
        return texts.select("t", F.length("t").alias("n"), F.upper("t").alias("upper"))

    return fn, seen


def test_second_run_computes_only_new_texts(spark, store, tmp_path):
    fn, seen = counting(spark)
    rows = [(k, t) for k, t in enumerate(["a", "b", "a", "", None, "hot"] + ["hot"] * 60)]
    df = spark.createDataFrame(rows, "id long, t string")
    want = sorted((k, t, None if t is None else len(t), t and t.upper()) for k, t in rows)
    got = store.apply(df, "t", "id", fn, hot_rows=10)
    assert sorted(tuple(r) for r in got.select("id", "t", "n", "upper").collect()) == sorted(
        ((k, t, n, "" if t == "" else u) for k, t, n, u in want), key=lambda r: r[0]
    )
    assert seen.value == 4
    again = store.apply(df, "t", "id", fn)
    assert again.count() == len(rows) and seen.value == 4
    # another session would open the folder again and find the results
    spark.sql(f"DROP TABLE {store.name}")
    other = TextStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4)
    more = df.unionByName(spark.createDataFrame([(100, "new"), (101, "b")], "id long, t string"))
    assert other.apply(more, "t", "id", fn).filter("n = length(t)").count() == len(rows) + 1
    assert seen.value == 5
    assert other.table().count() == 5


def test_store_is_not_shuffled(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fn, _ = counting(spark)
        df = spark.range(500).select("id", F.concat(F.lit("t"), F.col("id") % 50).alias("t"))
        store.apply(df, "t", "id", fn)
        joined = store.unknown(df, "t")
        lines = joined._jdf.queryExecution().executedPlan().toString().split("\n")
        at = next(k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
        above, depth = [], len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
        for line in reversed(lines[:at]):  # from the scan up to the join
            mine = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if mine < depth:
                depth = mine
                above.append(line.lstrip(" :+-*()0123456789").split(" ")[0])
        assert "SortMergeJoin" in above
        assert "Exchange" not in above[: above.index("SortMergeJoin")]
        assert joined.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty(spark, store):
    fn, seen = counting(spark)
    none = spark.createDataFrame([], "id long, t string")
    assert store.apply(none, "t", "id", fn).count() == 0 and seen.value == 0
    assert store.table().columns == [KEY, "n", "upper"]
