from __future__ import annotations

from lexiframe.llm import licenses as L
from lexiframe.llm import licensetexts as X


def test_canonical_forms(spark, docs, empty):
    mit = "The MIT Licence\n\nCopyright (c) 2020 Someone\nAll rights reserved.\n\n" + X.MIT
    rows = [
        (1, X.MIT), (2, "\n".join(X.MIT.lower().split())), (3, "/* " + X.MIT.replace("\n", "\n * ") + " */"),
        (4, "Copyright 1999 by X\n© 2001 Y\n" + X.MIT.replace("sublicense", "sub-licence")), (5, X.MIT + " And more."),
        (6, X.BSD_HEAD + X.BSD_TAIL), (7, X.BSD_HEAD + X.BSD_NAME.replace("holder", "owner") + X.BSD_TAIL), (8, X.ISC), (9, X.ZERO_BSD),
        (10, "Some code\nReleased under the MIT License.\nlicensed under cc by-nc 4.0\nLicensed under nothing"), (11, mit),
        (12, "Published under the GNU General Public Licence, Version 3"),
    ]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].licence for k in range(1, 10)] == ["MIT"] * 4 + [None, "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD"]
    assert (got[10].n_notices, got[10].notices, got[10].licence) == (2, "CC-BY-NC-4.0,MIT", None)
    assert got[12].licence == "GPL-3.0" and got[12].n_notices == 1


def test_odd_rows(docs, empty):
    out = L.scan(docs).collect()
    assert len(out) == docs.count()
    assert {r.licence for r in out} == {None} and {r.n_notices for r in out} == {0}
    assert L.scan(empty).count() == 0


def test_own_list(spark):
    docs = spark.createDataFrame([(1, "Do as you like!"), (2, "do what you like")], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in L.scan(docs, texts={"mine": ["do as YOU like", ""]}).collect()} == {1: "mine", 2: None}


def test_anchors_cover_all_known_texts(spark):
    marks = L.anchors(X.known_texts())
    assert len(marks) < 10 and "" not in marks
    assert all(any(m in t.lower() for m in marks) for each in X.known_texts().values() for t in each)
    assert L.anchors({"x": ["a b c"]}) == [""]


def test_own_texts_in_other_spellings(spark):
    pairs = [
        ("one licence", "one license"), ("a favour", "a favor"), ("go whilst on", "go while on"), ("to utilise", "to utilize"),
        ("copyright owners", "copyright holders"), ("as is, ÜBUNGEN", "AS IS ÜBUNGEN"), ("Copyright 2020 Someone\nuse it", "use it"),
    ]
    for known, text in pairs:
        assert any(m in text.translate(L._LOWER) for m in L.anchors({"mine": [known]})), known
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(pairs)], "doc_id long, text string")
    for k in (0, 1, 4):
        found = L.scan(docs, texts={"mine": [pairs[k][0]]}).collect()
        assert [r.doc_id for r in found if r.licence] == [k]
