from __future__ import annotations

import hashlib
from collections import defaultdict

import plain
import pytest

from lexiframe.llm import exactdedup as E


@pytest.mark.parametrize("max_blocks", [1, E.MAX_BLOCKS])
def test_as_plain(docs, pairs, max_blocks):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[plain.lower(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(
        ((i, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((i, plain.lower(t)) for i, t in pairs)), key=str
    )
    out = E.exact_copies(docs, max_blocks=max_blocks).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == want
    for text, ids in groups.items():
        kept = [r.doc_id for r in out if r.kept and r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert kept == [best[text]]  # one row, also of rows with the same id


def test_empty(empty):
    assert E.exact_copies(empty).count() == 0


def test_filter_has_no_misses(spark):
    rows = spark.range(4000).selectExpr("id % 3000 AS v", "id AS row").selectExpr("xxhash64(v) & 1099511627775 AS cell", "v", "row")
    cells = E.repeated_cells(rows)
    for blocks in (1, 64):
        out = E.maybe_repeated(rows, E.bloom_filter(cells, blocks), blocks).collect()
        assert len(out) == 4000
        assert all(r.maybe for r in out if r.v < 1000)
        assert sum(r.maybe for r in out if r.v >= 1000) < (400 if blocks == 1 else 10)


def test_sizes():
    assert E.filter_blocks(0) == E.MIN_BLOCKS and E.filter_blocks(10**15) == E.MAX_BLOCKS
    assert E.filter_blocks(10**6) * (1 << E.BLOCK_BITS) >= 16 * 10**6
