from __future__ import annotations

import random

import plain
import pytest

from lexiframe.llm import linededup as L


@pytest.mark.parametrize("counters", [16, L.COUNTERS])
def test_as_plain(spark, counters):
    rng = random.Random(3)
    vocabulary = [f"t{k}" for k in range(60)]
    texts = []
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
        texts.append("\n".join(" ".join(base[rng.randint(0, 2) :] + rng.sample(vocabulary, rng.randint(0, 2))) for _ in range(4)))
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_lines, list(r.removed)) for r in L.repeated_lines(docs, counters=counters).collect()]
    assert sorted(got, key=str) == sorted(plain.lines(rows), key=str)
    assert sum(len(r[2]) for r in got) > 50


def test_odd_rows(docs, empty, pairs):
    out = L.repeated_lines(docs)
    assert out.count() == docs.count()
    found = {r.doc_id: list(r.removed) for r in out.collect() if r.doc_id is not None}
    want = {d: gone for d, _, gone in plain.lines([p for p in pairs if p[0] not in (None, 20)])}
    assert {d: found[d] for d in want} == want
    # two equal rows are one document: judged alike, against document 1
    assert [r.n_removed for r in out.filter("doc_id = 20").collect()] == [1, 1]
    assert L.repeated_lines(empty).count() == 0


def test_a_hot_line(spark):
    rows = [(k, f"the very same line in every text\nown w{k} x{k} y{k} z{k}") for k in range(400)]
    out = L.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id > 0, tuple(r.removed)) for r in out} == {(False, ()), (True, (0,))}


def test_candidates_are_few(spark):
    """Lines that share rare tokens only are told apart inside the join; no similar pair goes with them."""
    rng = random.Random(5)
    lines = [" ".join([f"r{k % 20}", f"s{k % 20}", *rng.sample([f"w{j}" for j in range(400)], 14)]) for k in range(400)]
    lines += [f"{line} more" for line in lines[:50]]
    docs = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(lines)], "doc_id long, text binary")
    found = L.lines_of(docs, L.token_counts(docs.select("text"))).withColumnRenamed("doc_id", "rep")
    pairs = {(r.a, r.b) for r in L.candidates(found).collect()}
    assert {(k, 400 + k) for k in range(50)} <= pairs and len(pairs) < 100


def test_a_group_is_not_paired_in_full(spark, monkeypatch):
    """Lines that are all similar: one earlier match settles a line, so their pairs do not number its square."""
    words = [f"w{j}" for j in range(40)]
    rows = [(k, " ".join([*words[: k % 40], f"x{k}", *words[k % 40 + 1 :]])) for k in range(300)]
    made, stored = {}, L.stored

    def counted(df, name, *more):
        out = stored(df, name, *more)
        made[name] = out.count()
        return out

    monkeypatch.setattr(L, "stored", counted)
    got = L.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, list(r.removed)) for r in got) == plain.lines(rows)
    assert made["line-candidates"] < 300 * 30 and made["similar-lines"] < 300 * 30
