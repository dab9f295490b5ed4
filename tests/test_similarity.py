from __future__ import annotations

import numpy as np
import pytest

from lexiframe.operators import similarity as S


def brute(rows, queries, k):
    known = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and np.any(v)]
    out = []
    for q, v in queries:
        if q is None or v is None or not np.any(v):
            continue
        v = np.array(v, float)
        near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), i) for i, w in known)[:k]
        out += [(q, n + 1, i) for n, (_, i) in enumerate(near)]
    return sorted(out)


def clustered(seed, n, parts=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, parts))
    return [(k, (centres[k % 12] + 0.3 * rng.normal(size=parts)).tolist()) for k in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = clustered(0, 600)
    out += [(600 + k, out[5][1]) for k in range(30)]  # copies
    return [*out, (None, [1.0] * 8), (700, None), (701, [0.0] * 8)]


def tables(spark, rows, queries):
    kind = "id long, vector array<float>"
    return spark.createDataFrame(rows, kind).repartition(4), spark.createDataFrame(queries, kind)


@pytest.mark.parametrize("blocks", [(20_000, 50_000, 256), (7, 3, 2)])
def test_exact_as_brute_force(spark, monkeypatch, rows, blocks):
    for name, value in zip(("BLOCK_ROWS", "BLOCK_QUERIES", "CHUNK"), blocks):
        monkeypatch.setattr(S, name, value)
    rounded = [(i, v and np.float32(v).tolist()) for i, v in rows]
    queries = [r for r in rounded if r[0] is not None and r[0] % 50 == 0] + [(None, [1.0] * 8), (999, [0.0] * 8)]
    out = S.neighbours(*tables(spark, rows, queries), k=7, probes=2)
    assert sorted((r.query, r["rank"], r.id) for r in out.collect()) == brute(rounded, queries, 7)


def test_recall_of_the_approximate_search(spark, rows):
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0 and r[1]]
    want = {(q, i) for q, _, i in brute([(i, v and np.float32(v).tolist()) for i, v in rows], queries, 10)}
    got = {(r.query, r.id) for r in S.neighbours(*tables(spark, rows, queries), exact=False, probes=6).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_more_neighbours_than_rows_and_empty_tables(spark):
    few = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = S.neighbours(*tables(spark, few, few[:1]), k=5).collect()
    assert [(r.query, r["rank"], r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1), (1, 2, 2)]
    all_, one = tables(spark, few, few[:1])
    assert S.neighbours(all_.limit(0), one).count() == 0
    assert S.neighbours(all_, one.limit(0)).count() == 0
