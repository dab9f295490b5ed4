from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.functions import linguistics as L
from lexiframe.operators import gazetteer as Z
from lexiframe.operators import linguistics as O


def plain(tokens, phrases):
    """Leftmost, then longest, phrases that do not overlap."""
    out, at = [], 0
    while at < len(tokens):
        ends = [n for n in range(len(tokens) - at, 0, -1) if " ".join(tokens[at : at + n]) in phrases]
        if ends:
            out.append((at, at + ends[0] - 1, phrases[" ".join(tokens[at : at + ends[0]])]))
        at += ends[0] if ends else 1
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 200, 40])
def test_as_plain(spark, shard_bytes):
    rng = random.Random(shard_bytes)
    words = "a b c d e".split()
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 7))): rng.choice("XYZ") for _ in range(12)}
    docs = [(k, rng.choices([*words, "other"], k=rng.randint(0, 40))) for k in range(200)] + [(200, None), (201, [])]
    rows = spark.createDataFrame(docs, "h0 long, hits array<string>")
    listed = spark.createDataFrame([*phrases.items(), (None, "N"), ("", "E"), (" ", "S")], "phrase string, label string")
    out = Z.with_hits(rows, listed, F.col("hits"), "found", shard_bytes)
    assert out.columns == ["h0", "hits", "found"]
    got = {r.h0: [tuple(h) for h in r.found] for r in out.collect()}
    assert got == {k: plain(t or [], phrases) for k, t in docs}


def test_tree():
    tree = Z.Tree.of([("new york", "A"), ("new york city", "B"), ("city", "C")])
    import pyarrow as pa

    numbers = tree.numbers(pa.array("in new york city new york new".split()))
    first, last, label = tree.hits(numbers, np.full(7, 7))
    assert list(zip(first, last, (tree.labels[k] for k in label))) == [(1, 3, "B"), (3, 3, "C"), (4, 5, "A")]
    empty = Z.Tree.of([])
    assert [len(x) for x in empty.hits(empty.numbers(pa.array(["x"])), np.array([1]))] == [0, 0, 0]


def test_no_phrases_no_documents_repeated_rows(spark):
    docs = O.with_tokens(spark.createDataFrame([(1, "New York"), (1, "New York"), (2, None)], "id long, text string"), "text")
    none = spark.createDataFrame([], "phrase string, label string")
    names = spark.createDataFrame([("NEW  york", "B"), ("new york", "A"), ("york", None)], "phrase string, label string")
    assert O.match_entities(docs, "id", none).count() == 0
    assert O.match_entities(docs.limit(0), "id", names).count() == 0
    got = [tuple(r) for r in O.match_entities(docs, "id", names).collect()]
    assert got == [(1, 0, "New York", "A", 0, 1)] * 2
    assert [r.text for r in O.match_entities(docs, "id", names, max_n=1).collect()] == ["York"] * 2


def test_plan_moves_no_document(spark):
    docs = O.with_tokens(spark.range(10).select("id", F.lit("new york").alias("text")), "text")
    names = spark.createDataFrame([("new york", "A")], "phrase string, label string")
    plan = O.match_entities(docs, "id", names)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("shard_bytes", [1 << 20, 20])
def test_entities_of_texts_without_tokens(spark, shard_bytes):
    texts = ["In New York. York! NEW YORK city", "nothing", "", None, "new\nyork? new"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    names = spark.createDataFrame([("new york", "A"), ("york", "B")], "phrase string, label string")
    plain = Z.with_hits(O.with_tokens(docs, "text"), names, F.col(O.TOKENS)["lower"])
    want = plain.select("id", L.entity_string(Z.entities(F.col("hits"), F.col(O.TOKENS)["text"]), "text").alias("entities"))
    out = O.text_entities(docs, "text", names, "text", shard_bytes=shard_bytes)
    assert out.columns == ["id", "entities"]
    assert sorted(out.collect()) == sorted(want.collect())
    assert out.filter("id = 0").first().entities == "New York -> A , York -> B , NEW YORK -> A"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "struct<tok_id" not in plan and "is_stop" not in plan
