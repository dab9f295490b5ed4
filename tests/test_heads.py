from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import heads as H
from lexiframe.operators import linguistics as L
from lexiframe.operators import tagger as G
from lexiframe.plans.models import parsed_docs


def trees(n):
    """All projective trees of n words with one root, as tuples of heads (the root is its own)."""
    for heads in product(range(n), repeat=n):
        roots = [k for k in range(n) if heads[k] == k]
        if len(roots) != 1:
            continue

        def above(k):
            seen = []
            while heads[k] != k and k not in seen:
                seen.append(k)
                k = heads[k]
            return [*seen, k] if heads[k] == k else None

        chains = [above(k) for k in range(n)]
        if any(c is None for c in chains):
            continue
        spans = [(min(k, h), max(k, h), h) for k, h in enumerate(heads) if k != h]
        if all(h in chains[m] for a, b, h in spans for m in range(a + 1, b)):
            yield heads


@pytest.mark.parametrize("n", range(1, 7))
def test_as_all_trees(n):
    rng = np.random.default_rng(n)
    arcs, roots = rng.normal(size=(20, n, n)), rng.normal(size=(20, n))
    every = list(trees(n))
    worth = lambda s, t: sum(roots[s, k] if k == h else arcs[s, h, k] for k, h in enumerate(t))
    for s, found in enumerate(H.best_trees(arcs, roots).tolist()):
        best = max(every, key=lambda t: worth(s, t))
        assert tuple(found) == best, (found, best)


def test_seven_words():
    rng = np.random.default_rng(7)
    arcs, roots = rng.normal(size=(3, 7, 7)), rng.normal(size=(3, 7))
    every = list(trees(7))
    for s, found in enumerate(H.best_trees(arcs, roots).tolist()):
        worth = [sum(roots[s, k] if k == h else arcs[s, h, k] for k, h in enumerate(t)) for t in every]
        assert tuple(found) == every[int(np.argmax(worth))]


@pytest.mark.parametrize("cells", [1, 1 << 21])
def test_stretches(monkeypatch, cells):
    monkeypatch.setattr(H, "LONGEST", 4)
    monkeypatch.setattr(H, "MOST_CELLS", cells)
    rng = np.random.default_rng(0)
    lengths = np.array([3, 4, 9, 1, 5])
    starts = np.cumsum(lengths) - lengths
    kinds, tags = rng.integers(0, len(G.kinds()), 22), rng.integers(0, len(G.TAGS), 22)
    table = rng.normal(size=(len(G.kinds()),) * 2).astype(np.float32)
    heads = H.sentence_heads(table, kinds, tags, starts, lengths)
    for a, n in zip(starts, lengths):
        mine = heads[a : a + n]
        assert ((mine >= a) & (mine < a + n)).all() and (mine == np.arange(a, a + n)).sum() == 1
        first = [k for k in range(a, min(a + 4, a + n)) if heads[k] == k]
        assert len(first) == 1  # the first stretch holds the root
        for at in range(a + 4, a + n, 4):  # others hang on it by one word
            part = range(at, min(at + 4, a + n))
            assert [heads[k] for k in part if heads[k] not in part] == first


def whole(table, kinds, tags):
    """The best tree from full span tables."""
    return H.span_trees(*H.arc_scores(table, kinds[None], tags[None]))[0]


def words_of(rng, n, scale):
    size = len(G.kinds())
    table = (scale * rng.normal(size=(size, size))).astype(np.float32)
    return table, rng.integers(0, size, n), rng.integers(0, len(G.TAGS), n)


def test_long_sentences_are_parsed_whole():
    lengths = np.array([60, 3, 97, 49, 48, 1])
    starts = np.cumsum(lengths) - lengths
    table, kinds, tags = words_of(np.random.default_rng(1), lengths.sum(), 1.0)
    heads = H.sentence_heads(table, kinds, tags, starts, lengths)
    for a, n in zip(starts, lengths):
        assert (heads[a : a + n] - a == whole(table, kinds[a : a + n], tags[a : a + n])).all()


@pytest.mark.parametrize("scale", [0.0, 0.3, 1.0, 6.0])
@pytest.mark.parametrize("band", [1, 5, 40])
def test_bands_that_are_enough_give_the_best_tree(monkeypatch, scale, band):
    """Also where long links are worth it, and where many trees are equal."""
    rng = np.random.default_rng(int(scale * 10) + band)
    lengths = np.array([70, 51, 90])
    table, kinds, tags = words_of(rng, lengths.sum(), scale)
    used, spans = [], H._spans

    def watched(*args):
        used.append((len(args[1]), args[-1], spans(*args)[2]))
        return spans(*args)

    monkeypatch.setattr(H, "_spans", watched)
    heads = H.long_trees(table, kinds, tags, lengths, band)
    for a, n in zip(np.cumsum(lengths) - lengths, lengths):
        assert (heads[a : a + n] - a == whole(table, kinds[a : a + n], tags[a : a + n])).all()
    if scale == 6:  # doubled up to the sentence
        assert {b for _, b, _ in used} >= {69, 50, 89}
    if scale == 0 and band == 40:  # shown for each sentence
        assert {b for _, b, _ in used} == {40}


def test_a_link_across_a_long_sentence_is_found():
    """One pair of words far apart is worth more than the distance costs; no stretch or band may hide it."""
    n, size = 120, len(G.kinds())
    table = np.zeros((size, size), np.float32)
    table[1, 2] = 200
    kinds, tags = np.zeros(n, np.int64), np.full(n, G.TAGS.index("NOUN"))
    kinds[2], kinds[110] = 1, 2
    heads = H.sentence_heads(table, kinds, tags, np.array([0]), np.array([n]))
    assert heads[110] == 2 or heads[2] == 110
    assert (heads == whole(table, kinds, tags)).all()


def test_time_and_memory_of_a_very_long_sentence():
    """Tables of 20,000 words squared would not fit."""
    table, kinds, tags = words_of(np.random.default_rng(2), 20_000, 0.3)
    heads = H.sentence_heads(table, kinds, tags, np.array([0]), np.array([20_000]))
    assert (heads == np.arange(20_000)).sum() == 1


def test_counts(spark):
    docs = L.with_tokens(spark.createDataFrame([(1, "the good dog. the good cat!"), (2, "the dog"), (3, None)], "id long, text string"), "text")
    names = G.kinds()
    got = {(names[r.left], names[r.right]): r.n for r in H.near_counts(docs).collect()}
    assert got[("=the", "=good")] == 2 and got[("=the", "lower-")] == 3 and got[("=good", "lower-")] == 2
    assert ("mark", "=the") not in got and got[("lower-", "mark")] == 2
    table = H.mutual_information(np.array([[0, 4.0], [2.0, 2.0]]))
    assert table[0, 0] == 0 and np.isclose(table[0, 1], np.log((4 + 0.5) / (4 * 6 / 8 + 0.5)))
    assert not H.mutual_information(np.zeros((2, 2))).any()


def test_with_heads(spark):
    rows = [(1, "The service was not good. I loved the good food!"), (2, ""), (3, None), (4, "one"), (5, "a " * 200)]
    docs = L.with_tokens(spark.createDataFrame(rows, "c0 long, heads string"), "heads", annotate=True)
    out = H.with_heads(docs, H.association(docs))
    assert out.columns == ["c0", "heads", "tokens"]
    found = {r.c0: r.tokens for r in out.collect()}
    assert found[2] == [] and found[3] == [] and found[4][0].head_tok_id == 0 and found[4][0].dep == "ROOT"
    first = {t.text: found[1][t.head_tok_id].text for t in found[1]}
    assert first["the"] == "food" and first["food"] == "loved" and first["loved"] == "loved"
    assert all(t.sent_id == found[1][t.head_tok_id].sent_id for t in found[1])
    assert sum(t.dep == "ROOT" for t in found[5]) == 1 and len(found[5]) == 200
    assert H.with_heads(docs.limit(0), H.association(docs.limit(0))).count() == 0
    nulls = docs.withColumn("tokens", F.when(F.col("c0") > 3, F.col("tokens")))
    assert {r.c0: r.tokens for r in H.with_heads(nulls, H.association(docs)).collect()}[1] is None


def test_links_need_no_lemmas(spark):
    """The same links from tokens with word classes only, as the queries store them."""
    rows = spark.createDataFrame([(1, "The service was not good. I loved the good food!"), (2, None)], "id long, text string")
    found = []
    for fields in (["pos"], ["pos", "lemma", "morph"]):
        docs = L.with_tokens(rows, "text", annotate=True, fields=fields)
        out = H.with_heads(docs, H.association(docs), fields=fields)
        found.append([[(t.text, t.pos, t.dep, t.head_tok_id) for t in r.tokens] for r in out.orderBy("id").collect()])
        assert [f.name for f in out.schema["tokens"].dataType.elementType.fields][6:] == [*fields, "dep", "head_tok_id"]
    assert found[0] == found[1] and len(found[0][0]) == 12


def test_stored_tokens_hold_what_trees_read(spark, sf):
    names = [f.name for f in parsed_docs(spark, sf).schema["tokens"].dataType.elementType.fields]
    assert names == ["tok_id", "sent_id", "text", "lower", "is_alpha", "is_stop", "pos", "dep", "head_tok_id"]


def test_tokens_stay_where_they_are(spark):
    """Only texts, sentences and classes go to the parser, and learning reads numbers, not tokens."""
    docs = L.with_tokens(spark.createDataFrame([(1, "I loved the good food!")], "id long, text string"), "text", annotate=True)
    for out in (G.with_tags(docs, G.start_model()), H.with_heads(docs, H.association(docs))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    (row,) = G.numbered(docs).collect()
    assert row.lengths == [6] and [G.kinds()[k] for k in row.kinds][2] == "=the"
