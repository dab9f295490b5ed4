from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import resample as R


def want(docs, target, share=10, fewest=20, longest=1):
    """Per document (id, n_features, weight, score, rank); rows that repeat an id are told apart by their order."""

    def runs(text):
        w = plain.names(text)
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % R.BUCKETS for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(x for _, d in docs for x in runs(d)), Counter(x for d in target for x in runs(d))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + R.BUCKETS) / ((s[b] + 1) * (all_t + R.BUCKETS))))
    rows = []
    for doc, text in docs:
        f = runs(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(f), weight, score, None, len(plain.names(text)) >= fewest])
    usable = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(usable[: share * len(usable) // 100]):
        row[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("share,longest", [(50, 1), (100, 2), (0, 3)])
def test_as_plain(spark, docs, pairs, share, longest):
    target = ["alpha beta gamma", None, "same line of words", "w1x1 w2x2 " * 30]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = R.resample(docs, wanted, share=share, longest=longest)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want(pairs, target, share, 20, longest)


def test_empty(docs, empty, spark):
    none = spark.createDataFrame([], "text string")
    assert R.resample(empty, docs).count() == 0
    assert R.resample(docs, none).count() == docs.count()


@pytest.mark.parametrize("stretch", [1, 5, 1 << 20])
def test_stretches_of_long_texts(monkeypatch, stretch):
    monkeypatch.setattr(R, "STRETCH", stretch)
    text = "One two, three! Ünï 4ever\nand  more words"
    for longest in (1, 2, 3):
        w = plain.names(text)
        runs = [" ".join(w[k : k + n]).encode() for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
        got = list(R.feature_buckets(text.encode(), longest))
        assert sum(n for n, _ in got) == len(w)
        assert sorted(np.concatenate([b for _, b in got])) == sorted(zlib.crc32(r) % R.BUCKETS for r in runs)


@pytest.mark.parametrize("cuts", [2, 16])
def test_ties_at_the_cut(spark, cuts):
    ids = [*range(-40, 40), None, None, 7, 7, 7, -(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(i, (k * 7) % 3, k) for k, i in enumerate(ids)], "doc_id long, score long, row long").cache()
    order = [r.row for r in rows.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row").collect()]
    for need in [0, 1, 30, 31, 57, 60, len(ids)]:
        got = rows.filter(R.drawn(rows, need, cuts))
        assert sorted(r.row for r in got.collect()) == sorted(order[:need])
    ranked = {r.row: r["rank"] for r in R.with_ranks(rows).collect()}
    assert ranked == {row: k + 1 for k, row in enumerate(order)}


def test_threshold(spark):
    rows = spark.range(1000).selectExpr("(id * 37) % 101 - 50 AS v").cache()
    values = sorted((r.v for r in rows.collect()), reverse=True)
    for need in (1, 10, 1000):
        cut, above = R.threshold(rows, "v", need)
        assert cut == values[need - 1] and above == sum(v > cut for v in values)
