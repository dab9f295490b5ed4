from __future__ import annotations

import numpy as np
import plain
import pytest

from lexiframe.llm import quality as Q


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return Q.fit(*tables)


def test_held_out(tables, model):
    scores = Q.quality_scores(*tables, model=model)
    rows = scores.join(tables[1].select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert all(plain.remainder(r.doc_id, 3) == 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def naive(text, model):
    """The network as its definition reads."""
    padded = text + b"\0" * (Q.SPAN - 1)
    one = np.array([sum(model.vectors[padded[t + s]] @ model.filters[s] for s in range(Q.SPAN)) for t in range(len(text))])
    feats = np.zeros((2, Q.FILTERS))
    if len(text):
        one = np.maximum(one + model.bias, 0)
        halves = [one[k : k + Q.HALF].max(0) for k in range(0, len(text), Q.HALF)]
        chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
        feats = np.array([np.max(chunks, 0), np.mean(chunks, 0)])
    return 1 / (1 + np.exp(-((feats * model.heads).sum() + model.base)))


def test_score_as_defined(model):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 5, 6, 255, 256, 257, 512, 513, 1500, 0, 70_000, 3)]
    got = Q.score(texts, model, Q.pair_tables(model))
    assert np.allclose(got, [naive(t, model) for t in texts], atol=1e-4)


def test_odd_rows(spark, docs, empty, model):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (99, 0), (4, 0)], "doc_id long, quality int")
    out = Q.quality_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert len({r.score for r in out if r.doc_id in (4, 5)}) == 1
    assert len({r.score for r in out if r.doc_id in (1, 20)}) == 1
    assert {r.score for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(empty, labels).count() == 0
    kept = Q.accepted(docs, labels, model=model)
    assert kept.columns == docs.columns
    good = sorted((r.doc_id for r in Q.quality_scores(docs, labels, model=model).filter("predicted = 1").collect()), key=str)
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == good
    assert Q.accepted(empty, labels, model=model).count() == 0
