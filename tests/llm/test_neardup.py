from __future__ import annotations

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import neardup as N


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    a = {int(k): float(w) for k, w in zip(rng.integers(1, 2**53, 80), rng.uniform(0.5, 4, 80))}
    b = dict(list(a.items())[:60]) | {int(k): 2.0 for k in rng.integers(1, 2**53, 20)}
    b[next(iter(a))] *= 3
    exact = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in {*a} & {*b})
    doc = np.repeat([0, 1], [len(a), len(b)])
    key = np.array([*a, *b], np.uint64)
    registers = 4000
    table = N.signatures(doc, key, np.array([*a.values(), *b.values()]), 2, registers)
    assert abs((table[0] == table[1]).mean() - exact) < 0.03
    # early termination changes nothing: each document alone gives the same
    alone = N.signatures(np.zeros(len(a), np.int64), key[: len(a)], np.array([*a.values()]), 1, registers)
    assert (alone[0] == table[0]).all()


def as_rows(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in df.collect()), key=str)


def test_as_plain(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(500)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(4, 150))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = N.near_duplicates(docs)
    assert as_rows(out) == sorted(plain.near_classes(rows), key=str)
    assert out.filter("kept").count() == out.select("class_id").distinct().count()


def test_repeated_lines(spark):
    """A text and the same with a line appended many times, or with some words repeated."""
    rng = random.Random(3)
    rows = []
    for k in range(12):
        base = [f"t{k}w{rng.randrange(10**6)}" for _ in range(104)]
        line = [f"t{k}l{rng.randrange(10**6)}" for _ in range(16)]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base + 20 * line))]
        rows += [(10 * k + 2, " ".join(line + base[:80])), (10 * k + 3, " ".join(30 * line + base[:80]))]
    want = plain.near_classes(rows)
    assert sum(n > 1 for *_, n in want) >= 24
    assert as_rows(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(want, key=str)


def test_sketch_loses_no_similar_pair(spark):
    """Sets right at the threshold, of 4 against 5 shingles and more, pass the test before verification."""
    rng = random.Random(5)
    texts = []
    for size in (4, 8, 12, 40, 200, 2000):
        for _ in range(600 if size < 40 else 40):
            base = [f"w{rng.randrange(10**9)}" for _ in range(size + 4)]
            texts += [" ".join(base), " ".join(base + [f"w{rng.randrange(10**9)}" for _ in range(size // 4)])]
    rows = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "id long, text binary")
    facts = N.signed(rows).selectExpr("id", "struct(n, sketch, bands) AS facts").cache()
    ours = facts.filter("id % 2 = 0").selectExpr("id", "facts AS ours")
    both = ours.join(facts.selectExpr("id - 1 AS id", "facts AS theirs"), "id")
    assert both.count() == len(texts) // 2
    assert both.filter("abs(ours.n / theirs.n - 0.8) > 1e-9").count() == 0
    assert both.filter(~N._alike("ours", "theirs")).count() == 0


def test_equal_sets_of_few_shingles(spark):
    """Phrases of one to six words, repeated a different number of times."""
    phrases = ("word", "buy now", "one two three", "a b c d", "v w x y z", "p q r s t u")
    rows = list(enumerate(" ".join([phrase] * n) for phrase in phrases for n in (1, 2, 5, 50, 60, 300)))
    got = as_rows(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(plain.near_classes(rows), key=str)
    assert (1, 1, 1) in got and (2, 2, 4) in got


def test_one_large_group(spark):
    rng = random.Random(1)
    base = [f"v{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for k in range(250):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(base)) for k in range(250)] + [(5000, "quite another text of some words")]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.class_id, r.class_size) for r in out.collect()} == {(0, 500), (5000, 1)}


def test_odd_rows(docs, empty, pairs):
    out = N.near_duplicates(docs)
    assert as_rows(out) == sorted(plain.near_classes(pairs), key=str)
    kept = N.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == sorted(
        (r.doc_id for r in out.filter("kept").collect()), key=str
    )
    assert (kept.filter("doc_id = 4").first().text, kept.filter("doc_id = 4").first().source) == ("", "b")
    assert N.near_duplicates(empty).count() == 0 and N.deduplicated(empty).count() == 0


def roots(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        parent[max(top(u), top(v))] = min(top(u), top(v))
    return {k: top(k) for k in range(n)}


@pytest.mark.parametrize("kind", ["chain", "shuffled", "random"])
def test_classes_merge_in_few_passes(spark, monkeypatch, kind):
    rng = random.Random(4)
    n = 200
    order = list(range(n))
    if kind == "shuffled":
        rng.shuffle(order)
    links = list(zip(order, order[1:])) if kind != "random" else [(rng.randrange(n), rng.randrange(n)) for _ in range(150)]
    passes = []
    stored = N.stored
    monkeypatch.setattr(N, "stored", lambda df, name: passes.append(name) or stored(df, name))
    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in links if a != b], "u long, v long")
    classes = spark.range(n).select(F.col("id").alias("rep"), F.col("id").alias("class"))
    got = {r.rep: r["class"] for r in N.merged(classes, pairs).collect()}
    assert got == roots(n, links)
    assert passes.count("classes") <= 8 and passes.count("class-moves") <= 24
