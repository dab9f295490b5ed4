from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiframe.functions import linguistics as L
from lexiframe.operators import enrich as E
from lexiframe.operators import keyphrases as K
from lexiframe.operators import linguistics as O

TOKENS = [
    (1, 0, "customer", True, False, "NOUN", "nsubj", 1),
    (1, 1, "loved", True, False, "VERB", "ROOT", 1),
    (1, 2, "service", True, False, "NOUN", "dobj", 1),
    (1, 3, ".", False, False, "PUNCT", "punct", 1),
]
SCHEMA = (
    "doc_id long, tok_id int, text string, is_alpha boolean, is_stop boolean, pos string, dep string, head_tok_id int"
)


@pytest.fixture(scope="module")
def docs(spark):
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    rows = spark.createDataFrame(TOKENS[::-1], SCHEMA)
    return O.assemble(rows, "doc_id", ids).cache()


def values(docs, column):
    return {r.doc_id: r.v for r in docs.select("doc_id", column.alias("v")).collect()}


def test_strings_from_a_supplied_token_table(docs):
    t = F.col(O.TOKENS)
    assert values(docs, L.pos_string(t, "text")) == {
        1: "customer -> NOUN , loved -> VERB , service -> NOUN", 2: "No POS tags found",
    }
    assert values(docs, L.pos_string(t, "column")) == {
        1: "customer -> NOUN | loved -> VERB | service -> NOUN", 2: "No pos found",
    }
    assert values(docs, L.dependency_string(t, "text")) == {
        1: "customer ->nsubj -> loved , loved ->ROOT -> loved , service ->dobj -> loved",
        2: "No dependnecy parsing found",
    }
    assert values(docs, L.dependency_string(t, "column")) == {
        1: "customer ->NOUN->nsubj -> loved | loved ->VERB->ROOT -> loved | service ->NOUN->dobj -> loved",
        2: "No dependency parsing found for given row",
    }
    assert values(docs, L.pos_weightage(t)) == {
        1: {"Pronoun": 0, "Adjective": 0, "Noun": 66, "Verb": 33}, 2: {},
    }
    assert values(docs, L.keyword_stopword_ratio(t)) == {
        1: "keywords -> 3 , stopwords -> 0 , ratio -> 3.0", 2: "keywords -> 0 , stopwords -> 0 , ratio -> 0.0",
    }
    assert values(docs, L.negations(t)) == {1: [], 2: []}


def test_entity_strings(spark, docs):
    found = spark.createDataFrame(
        [(1, 0, "Microsoft", "ORG"), (1, 1, "India", "GPE")], "doc_id long, ent_id int, text string, label string"
    )
    got = O.entity_strings(docs.select("doc_id"), "doc_id", found, "text").orderBy("doc_id").collect()
    assert [r.entities for r in got] == [
        "Microsoft -> ORG , India -> GPE", "No entity relation found for given input",
    ]


def test_readability(spark):
    rows = O.with_tokens(spark.createDataFrame([(1, "customer loved service"), (2, "")], "id int, text string"), "text")
    metric = L.readability_string(L.readability_metrics(F.col("text"), F.col(O.TOKENS)))
    got = {r.id: r.m for r in rows.select("id", metric.alias("m")).collect()}
    assert got[1] == "avg_sentence_length -> 3.0 , avg_word_length -> 6.67 , complexity_score -> 4.47"
    assert got[2] == "avg_sentence_length -> 0.0 , avg_word_length -> 0.0 , complexity_score -> 0.0"


def worded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return O.with_tokens(rows, "text", words={"en": ["the", "of"]})


def test_graph(spark):
    docs = worded(spark, ["aa bb cc dd ee", "aa aa bb", "aa"])
    edges = {(r.id, r.src, r.dst) for r in K.cooccurrence_edges(docs, "id").collect()}
    first = {"aabb", "aacc", "aadd", "bbcc", "bbdd", "bbee", "ccdd", "ccee", "ddee"}
    assert {s + d for i, s, d in edges if i == 0} == first
    assert {s + d for i, s, d in edges if i == 1} == {"aaaa", "aabb"}
    scores = {(r.id, r.node): round(r.score, 4) for r in K.pagerank(docs, "id").collect()}
    assert scores == {
        (0, "aa"): 0.1702, (0, "ee"): 0.1702, (0, "bb"): 0.2199, (0, "cc"): 0.2199, (0, "dd"): 0.2199,
        (1, "aa"): 0.6491, (1, "bb"): 0.3509,
    }


def test_content_words_without_tokens(spark):
    texts = ["The Cat. sat?of 12 the mat", "cafe\u0301 of the caf\u00e9 x_y", "", None, "aa\u0301 bb.cc! \u03a3\u0391\u03a3 \u0130x"]
    rows = [(k, lang, t) for k, t in enumerate(texts) for lang in ("en", "de", None)]
    docs = spark.createDataFrame([(f"{k}{lang}", lang, t) for k, lang, t in rows], "id string, lang string, text string")
    words = {"en": ["the", "of"], "de": ["cat"]}
    plain = O.with_tokens(docs, "text", "lang", words=words)
    short = O.with_content_words(docs, "text", "lang", words=words)
    want = {r.id: r.w for r in plain.select("id", L.content(F.col(O.TOKENS))["lower"].alias("w")).collect()}
    assert {r.id: r[O.WORDS_COLUMN] for r in short.collect()} == want and want["0de"] == ["the", "sat", "of", "the", "mat"]
    for step in (K.cooccurrence_edges, K.pagerank):
        got = sorted(step(short.select("id", O.WORDS_COLUMN), "id").collect())
        assert got and got == sorted(step(plain.select("id", O.TOKENS), "id").collect())


def slow_pagerank(words):
    """One document, one node at a time."""
    links = {}
    for i, word in enumerate(words):
        for other in words[i + 1 : i + 4]:
            links.setdefault(word, set()).add(other)
            links.setdefault(other, set()).add(word)
    n = len(links)
    x = dict.fromkeys(links, 1 / n if n else 0)
    for _ in range(100):
        new = {w: 0.15 / n + 0.85 * sum(x[o] / len(links[o]) for o in links if w in links[o]) for w in links}
        change = sum(abs(new[w] - x[w]) for w in links)
        x = new
        if change < n * 1e-6:
            break
    return x


def test_pagerank_against_brute_force():
    rng = np.random.default_rng(3)
    batch = [rng.integers(0, 12, size=n).tolist() for n in (40, 7, 2, 1, 0, 90)]
    dense = [pd.factorize(np.array(b))[0] for b in batch]
    for ids, got in zip(dense, K.pagerank_scores(pd.Series(dense))):
        want = slow_pagerank(ids.tolist())
        assert np.allclose(got, [want.get(i, 0.0) for i in range(len(got))], atol=1e-12)
        if want:
            assert abs(sum(got) - 1) < 1e-6


def test_column_keyphrases_against_brute_force(spark):
    texts = [
        "red fox of the red barn fox barn the fox", "aa bb the cc dd of aa bb", "one", "", "aa aa the aa aa of bb cc",
    ]
    got = {r.id: r.key_phrase for r in K.keyphrases(worded(spark, texts), "column").collect()}
    for i, text in enumerate(texts):
        runs, run = [], []
        for word in [*text.split(), "the"]:
            if word in ("the", "of"):
                runs, run = runs + ([run] if len(run) > 1 else []), []
            else:
                run = [*run, word]
        freq = Counter(w for w in text.split() if w not in ("the", "of"))
        norm = sum(n * n for n in freq.values()) ** 0.5

        def score(run):
            counts = Counter(run)
            dot = sum(n * freq[w] for w, n in counts.items())
            own = sum(n * n for n in counts.values()) ** 0.5
            return 0.7 * dot / (own * norm) + 0.3 * sum(freq[w] for w in run) / max(freq.values())

        ranked = sorted(runs, key=lambda r: -round(score(r), 9))
        assert got[i] == (" | ".join(" ".join(r) for r in ranked) or "No key phrase found for given row")


def test_entities_prefer_the_longest_from_the_left(spark):
    docs = worded(spark, ["New York City Hall", "york city"])
    names = spark.createDataFrame(
        [("new york", "A"), ("York City Hall", "B"), ("New York City", "C"), ("city", "D"), (None, "E"), ("", "F")], "phrase string, label string"
    )
    got = [(r.id, r.text, r.label) for r in O.match_entities(docs, "id", names).orderBy("id", "ent_id").collect()]
    assert got == [(0, "New York City", "C"), (1, "city", "D")]


def test_repeated_texts_run_once_and_reach_every_row(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("t"))
    got = E.dedup_apply(rows, "t", "id", lambda d: d.withColumn("n", F.length("t")), hot_rows=50)
    assert got.count() == 2000
    assert got.filter("n <> length(t) or n is null").count() == 0


def test_missing_column_gets_an_error_column(spark):
    rows = spark.createDataFrame([(1, "Hello <b>you</b>")], "id int, note string")
    got = E.enrich(rows, ["note", "absent"], "id").first().asDict()
    assert got["note"] == "hello you" and got["absent__error"] == "Processing failed"
    assert set(got) == {
        "id", "note", "note__pos", "note__dependency", "note__ner", "note__key_phrase", "absent__error",
    }


def test_embedding_makes_tokens_once(spark):
    rows = spark.createDataFrame([(1, "red fox red"), (2, "fox"), (3, ""), (4, None)], "id long, text string")
    out = K.embed(O.with_tokens(rows, "text"), 8, keep=["id"])
    assert out.columns == ["id", "embedding"]
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r.id: np.array(r.embedding) for r in out.collect()}
    assert np.isclose(np.linalg.norm(found[1]), 1) and np.isclose(np.linalg.norm(found[2]), 1)
    assert not found[3].any() and not found[4].any() and len(found[4]) == 8


def test_only_wanted_annotations_are_made(spark):
    rows = [(1, "en", "She never loved 3 good, badly painted houses. Not cities!"), (2, "fr", "Le chat"), (3, None, None), (4, "xx", "the")]
    table = spark.createDataFrame(rows, "id long, lang string, text string")
    whole, some = (O.with_tokens(table, "text", "lang", heads=True, **o) for o in ({}, {"fields": ["pos"]}))
    names = some.schema["tokens"].dataType.elementType.names
    assert "lemma" not in names and "morph" not in names
    read = lambda df: sorted(tuple(r) for r in O.token_rows(df, "id").select("id", *names).collect())
    assert read(some) == read(whole)
    tags = O.tagged_rows(O.with_tokens(table, "text", "lang"), "id").select("id", "tok_id", "pos", "is_stop").collect()
    assert sorted(map(tuple, tags)) == sorted(map(tuple, O.token_rows(whole, "id").select("id", "tok_id", "pos", "is_stop").collect()))
