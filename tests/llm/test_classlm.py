from __future__ import annotations

from collections import Counter

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import classlm as C


def likelihood(counts, owner, classes):
    member = np.zeros((len(owner), classes))
    member[np.arange(len(owner)), owner] = 1
    table = member.T @ counts @ member
    rows, columns = table.sum(1), table.sum(0)
    return C._xlogx(table).sum() - C._xlogx(rows).sum() - C._xlogx(columns).sum()


def test_exchange_ends_when_no_unit_moves():
    counts = np.random.default_rng(4).poisson(1.0, (121, 121)).astype(float)
    owner = C.exchange(counts, 8)
    assert (owner == C.exchange(counts, 8, 1000)).all() and (owner != C.exchange(counts, 8, 12)).any()


def test_every_sweep_raises_the_likelihood_to_the_end():
    counts = np.random.default_rng(4).poisson(1.0, (121, 121)).astype(float)
    reached = [likelihood(counts, C.exchange(counts, 8, k, full_totals=True), 8) for k in range(1, 15)]
    assert (np.diff(reached) > -1e-6).all()
    owner = C.exchange(counts, 8, full_totals=True)
    for u in range(120):  # no single move is better
        for g in range(1, 8):
            moved = owner.copy()
            moved[u] = g
            assert likelihood(counts, moved, 8) <= likelihood(counts, owner, 8) + 1e-6


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    true = np.append(rng.integers(1, 4, 30), 0)
    chance = rng.dirichlet([0.3] * 4, 4)
    counts = np.zeros((31, 31))
    for u in range(31):
        for v in range(31):
            counts[u, v] = rng.poisson(60 * chance[true[u], true[v]])
    owner = C.exchange(counts, 4, 30)
    assert owner[-1] == 0 and (owner[:-1] > 0).all()
    assert likelihood(counts, owner, 4) >= likelihood(counts, true, 4) - 1e-6
    for u in range(30):  # no single move is better
        for g in range(1, 4):
            moved = owner.copy()
            moved[u] = g
            assert likelihood(counts, moved, 4) <= likelihood(counts, owner, 4) + 1e-6


@pytest.mark.parametrize("held", [3, C.HELD_WORDS])
def test_odd_rows(docs, pairs, held):
    out = C.score_texts(docs, held_words=held).collect()
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str)
    assert got == sorted(((*b[:4], round(b[4], 6)) for b in plain.base_scores(pairs)), key=str)
    assert all(r.score < 0 and r.held_out == (plain.remainder(r.doc_id, 10) == 0) for r in out)


def test_empty(empty, docs):
    assert C.score_texts(empty).count() == 0
    held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    assert all(r.train_tokens == 0 for r in C.score_texts(held).collect())


def test_held_out_and_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = C.score_texts(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]
    texts = docs.filter(C.remainder(F.col("doc_id"), 10) != 0).select(F.col("text").cast("binary"))
    model, others = C.fit(texts)
    assert np.allclose((10**model.step).sum(1), 1)
    # words of a class and the one unknown word share all of its probability
    mass = C.ADDED / 10**model.below
    known = [(model.classes[w], n) for w, n in model.held.items() if n] + [(r["class"], r.n) for r in others.collect()]
    for c, n in known:
        mass[c] += (n + C.ADDED) / 10 ** model.below[c]
    assert np.allclose(mass, 1) and len(known) == model.types


def fitted(docs, held):
    """The model on the training texts, with counts and classes of all words in plain dicts."""
    texts = docs.filter(C.remainder(F.col("doc_id"), 10) != 0).select(F.col("text").cast("binary"))
    model, others = C.fit(texts, held)
    rare = {bytes(r.word).decode(): (r.n, r["class"]) for r in others.collect()}
    counts = {w.decode(): n for w, n in model.held.items()} | {w: n for w, (n, _) in rare.items()}
    classes = {w.decode(): c for w, c in model.classes.items()} | {w: c for w, (_, c) in rare.items()}
    return model, counts, classes


@pytest.mark.parametrize("held,own", [(3, 2), (40, 20), (C.HELD_WORDS, C.OWN_WORDS)])
def test_scores_as_plain(monkeypatch, docs, pairs, held, own):
    monkeypatch.setattr(C, "OWN_WORDS", own)
    model, counts, classes = fitted(docs, held)
    train = Counter(w for d, t in pairs if plain.remainder(d, 10) for w in [*plain.words(t), " "])
    assert counts == dict(train) and set(classes) == set(train)
    assert len(model.held) <= held + 1
    want = plain.class_scores(pairs, counts, classes, model.step, model.below, model.strange)
    got = [(r.doc_id, r.score) for r in C.score_texts(docs, held_words=held).collect()]
    key = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[0] == b[0] and np.isclose(a[1], b[1], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("held,own", [(3, 2), (40, 20), (C.HELD_WORDS, C.OWN_WORDS)])
def test_every_pair_of_neighbours_counts(monkeypatch, docs, pairs, held, own):
    """Also those of two words that tasks do not hold."""
    monkeypatch.setattr(C, "OWN_WORDS", own)
    model, counts, classes = fitted(docs, held)
    steps = np.full((C.CLASSES, C.CLASSES), C.CLASS_ADDED)
    for d, t in pairs:
        if plain.remainder(d, 10):
            ws = [" ", *plain.words(t), " "]
            for a, b in zip(ws, ws[1:]):
                steps[classes[a], classes[b]] += 1
    assert np.allclose(model.step, np.log10(steps / steps.sum(1, keepdims=True)))


def test_pairs_of_rare_words(spark):
    texts = spark.createDataFrame([(b"x a b a the b b b",), (b"b",), (b"a",), (b"the",), (b"",)], "text binary")
    others = spark.createDataFrame([(b"x", 1), (b"a", 2), (b"b", 3)], "word binary, class int")
    found = C.rare_pairs(C.coded(texts, [b"the", C.END]), others).collect()
    assert {(r["before"], r["class"]): r.n for r in found} == {(1, 2): 1, (2, 3): 1, (3, 2): 1, (3, 3): 2}


def test_every_word_goes_where_it_is_likeliest(docs, pairs):
    texts = docs.select(F.col("text").cast("binary"))
    classes = {b" ": 0, b"beta": 1, b"word": 2, b"same": 3, b"b": 4, b"w1x1": 5}
    rng = np.random.default_rng(3)
    worth = tuple(rng.normal(size=(2, C.CLASSES, C.CLASSES)))
    want = plain.best_classes([t for _, t in pairs], {w.decode(): c for w, c in classes.items()}, worth)
    got = {bytes(r.word).decode(): r["class"] for r in C.assigned(C.neighbours(texts, classes, None), worth).collect()}
    assert set(got) == set(want)
    for word, value in want.items():
        assert value[got[word]] >= max(value[1:]) - 1e-9
    some = [b"alpha", b"line"]
    part = {bytes(r.word).decode(): r["class"] for r in C.assigned(C.neighbours(texts, classes, some), worth).collect()}
    assert part == {w: got[w] for w in ("alpha", "line")}


def test_most_frequent(spark):
    counts = spark.createDataFrame([(bytes([65 + k]), n) for k, n in enumerate([5, 5, 3, 3, 3, 1])] + [(b" ", 1)], "word binary, n long")
    assert list(C.most_frequent(counts, 4)) == [b"A", b"B", b" "]
    assert list(C.most_frequent(counts, 5)) == [b"A", b"B", b"C", b"D", b"E", b" "]
    assert len(C.most_frequent(counts, 100)) == 7


def test_words_of_like_use_share_a_class(spark):
    """Rare words that stand between the same words go to one class, whatever their letters."""
    rng = np.random.default_rng(0)
    nouns, verbs = [f"n{k}x{k * 7 % 10}" for k in range(40)], [f"v{k}x{k * 7 % 10}" for k in range(40)]
    texts = [" ".join(f"the {rng.choice(nouns)} will {rng.choice(verbs)} ." for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    _, _, classes = fitted(docs, 4)
    kinds = [{classes[w] for w in each if w in classes} for each in (nouns, verbs)]
    assert len(kinds[0]) == len(kinds[1]) == 1 and kinds[0] != kinds[1]
