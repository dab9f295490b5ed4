from __future__ import annotations

import plain
import pytest
from conftest import PROSE

from lexiframe.llm import decontaminate as D

ITEMS = [
    (1, "zero alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi end"),
    (2, "Wörter zweite Zeile"),
    (2, "words in it"),
    (3, ""),
    (4, None),
    (None, "a b c d"),
    (5, "word " * 20),
    (5, "word " * 20),
    (6, "same line of words here now then nothing like it"),
    (7, PROSE),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, block long")


def rows(df):
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("round_bytes", [1_000_000, 60])
def test_as_plain(docs, items, pairs, round_bytes):
    want = sorted(plain.contamination(pairs, ITEMS), key=str)
    assert rows(D.contamination(docs, items, round_bytes=round_bytes)) == want
    clean = D.decontaminated(docs, items, round_bytes=round_bytes)
    assert clean.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()), key=str)
    bad = [c[-1] for c in plain.contamination(pairs, ITEMS)]
    assert left == sorted((p for p, b in zip(pairs, bad) if not b), key=str)


def test_one_item_larger_than_a_round(spark, docs, pairs):
    """An id with most rows is searched in several rounds, and is still one item."""
    items = [(7, t) for t in (PROSE, "a b c", "words in it", "zweite Zeile", "w1x1 w2x2 w3x3", None)] + [(8, "a b")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert D._items(table, "item_id", "text", 40)[1] > 4
    assert rows(D.contamination(docs, table, round_bytes=40)) == sorted(plain.contamination(pairs, items), key=str)


def test_empty_tables(docs, empty, items):
    assert D.contamination(empty, items).count() == 0
    assert D.decontaminated(empty, items).count() == 0
    assert {r[2] for r in rows(D.contamination(docs, items.limit(0)))} == {0}
    assert D.decontaminated(docs, items.limit(0)).count() == docs.count()


@pytest.mark.parametrize("tokens", [1, 50, 10**6])
def test_blocks_do_not_matter(spark, tokens):
    docs = spark.createDataFrame([(1, "the cat sat on the mat the cat"), (2, ""), (3, "cat the on sat")], "doc_id long, text string")
    index = D.build_index(docs, block_tokens=tokens)
    found = D.phrase_matches(index, [("x", "the cat"), ("y", "sat on the mat"), ("z", "mat cat")])
    assert sorted(map(tuple, found.collect())) == [(1, "x", 0), (1, "x", 6), (1, "y", 2)]
    near = D.phrase_matches(index, [("z", "mat cat"), ("w", "sat the"), ("v", "on sat")], slop=1)
    assert sorted(map(tuple, near.collect())) == [(1, "w", 2), (1, "z", 5), (3, "v", 2)]
