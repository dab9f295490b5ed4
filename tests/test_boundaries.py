from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lexiframe.operators import boundaries as B

TEXT = (
    "We met Dr. Smith at noon. The talk was long. He used many terms, e.g. some from old books. The end came late. "
    "Das ist z. B. ein Satz. The price is 3.14 today. It costs approx. nine. "
)


@pytest.fixture(scope="module")
def docs(spark):
    filler = "The day was fine. The sea was calm. He went home. The boats stayed out all day and the people watched. "
    filler += "At noon all books lay late and long at home, calm and fine, nine satz today, watched by one. "
    rows = [(k, TEXT * 6 + filler * 10) for k in range(6)] + [(50, ""), (51, None), (52, "no mark"), (53, "...!?")]
    return spark.createDataFrame(rows, "id long, text string")


def test_scores(spark):
    rows = spark.createDataFrame([(1, "dr. a dr. b dr. c end. the end the a b"), (2, None)], "id long, text string")
    got = {r.word: r for r in B.abbreviations(rows, "text").collect()}
    n_all, hits_all = 12, 4
    p = hits_all / n_all
    ratio = 2 * (3 * math.log(0.99) - 3 * math.log(p))
    assert got["dr"].n == 3 and got["dr"].hits == 3 and math.isclose(got["dr"].score, ratio * math.exp(-2), abs_tol=1e-8)
    assert "a" not in got
    first = {r.word: r for r in B.starters(rows, "text", ["dr"]).collect()}
    assert first["the"].n == 2 and first["the"].hits == 1 and set(first) == {"the"}


def test_abbreviations_do_not_end_sentences(docs):
    model = B.fit(docs, "text")
    assert {"dr", "g", "z", "b"} <= set(model.abbreviations) and "noon" not in model.abbreviations
    assert "the" in model.starters
    found = B.split_sentences(docs.filter("id = 0"), "id", "text", model).orderBy("sent_no").limit(6).collect()
    assert [r.sentence for r in found] == [
        "We met Dr. Smith at noon.", "The talk was long.", "He used many terms, e.g. some from old books.", "The end came late.",
        "Das ist z. B. ein Satz.", "The price is 3.14 today.",
    ]


def test_odd_rows(docs):
    model = B.Model(["dr"], ["the"])
    out = B.split_sentences(docs.filter("id >= 50"), "id", "text", model).collect()
    assert [(r.id, r.sentence) for r in out] == [(52, "no mark")]
    row = docs.limit(1).select(B.sentences(F.lit("Ask Dr. The rest waits. Dr. X. Wait!! dr.. so a.b"), model).alias("s")).first()
    assert row.s == ["Ask Dr.", "The rest waits.", "Dr. X.", "Wait!!", "dr..", "so a.b"]
    none = B.fit(docs.limit(0), "text")
    assert none.abbreviations == [] and none.starters == []
    assert B.split_sentences(docs.limit(0), "id", "text", none).count() == 0
    plain = docs.limit(1).select(B.sentences(F.lit("a. b. c"), none).alias("s")).first()
    assert plain.s == ["a.", "b.", "c"]
