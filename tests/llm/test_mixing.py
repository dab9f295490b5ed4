from __future__ import annotations

from collections import Counter

import plain
import pytest

from lexiframe.llm import mixing as M


def test_targets_and_bounds(docs, empty):
    out = M.mix(docs).collect()
    assert len(out) == docs.count()
    sizes = Counter()
    for r in out:
        sizes[r.source] += r.size
    want = plain.targets(sizes)
    longest = max(r.size for r in out)
    for source, size in sizes.items():
        mine = [r for r in out if r.source == source]
        assert {r.source_size for r in mine} == {size}
        assert all(abs(r.target - want[source]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - want[source]) <= longest
    assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in out)
    assert M.mix(empty).count() == 0 and M.mixed(empty).count() == 0


@pytest.fixture(scope="module")
def many(spark):
    rows = [(k, "w " * (1 + k * k % 97), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_near_targets_whatever_the_blocks(many):
    plans = [sorted(map(tuple, M.mix(many.repartition(n), block_rows=b).collect())) for n, b in ((2, 10**6), (5, 20))]
    assert plans[0] == plans[1]
    taken, target = Counter(), {}
    for r in plans[0]:
        taken[r[5]] += r[4]
        target[r[5]] = r[3]
    assert all(abs(taken[s] - t) <= 5 for s, t in target.items())


def test_long_documents_are_likelier(spark):
    rows = [(k, "w " * (10 if k % 2 else 200), "a" if k < 1500 else "b") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mix(docs, weights=(1, 2), share=1.0).filter("source = 'a'").collect()
    rate = {s: sum(r.copies for r in out if r.size == s) / 750 for s in (10, 200)}
    assert rate[200] > rate[10] + 0.1


def test_documents_repeat(docs):
    counted = {r.doc_id: r.copies for r in M.mix(docs).filter("doc_id <> 20 AND doc_id IS NOT NULL").collect()}
    out = M.mixed(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert all(got[d] == c for d, c in counted.items())
