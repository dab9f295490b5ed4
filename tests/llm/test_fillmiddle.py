from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiframe.llm import fillmiddle as M

ODD = ["", "a", "é", "日本語 text", "ab12 cd", "😀x😀", "a<P>b", "x<S>", "<M>", "<", "<P", "P><S", "word " * 50, "\x00\n\r\t", "ÄÖÜäöü" * 9]


def plain(doc, text, seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_as_plain(spark, docs, pairs):
    more = [(100 + k, t * r) for k, t in enumerate(ODD) for r in (1, 3)] + [(k, "Ab é1" * 3) for k in range(1000, 1400)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    done = M.transformed(rows)
    out = done.select("*", M.restored(F.col("output"), F.col("form")).alias("back"))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()), key=str)
    want = sorted(((*plain(d, t), t or "") for d, t in [*pairs, *more]), key=str)
    assert got == want
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_clashing_columns_and_empty(docs, empty):
    assert M.fill_in_middle(docs).count() == docs.count()
    assert M.fill_in_middle(empty).count() == 0


def test_stretches(monkeypatch):
    rng = random.Random(3)
    for stretch in (1, 2, 3, 7):
        monkeypatch.setattr(M, "STRETCH", stretch)
        for _ in range(60):
            text = "".join(rng.choices("abcé日😀 .1", k=rng.randint(0, 30)))
            data, tokens = text.encode(), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
            counts = M.token_counts(data)
            assert (int(counts[-1]) if len(counts) else 0) == len(tokens)
            for k in range(len(tokens) + 1):
                assert M.token_place(data, counts, k) == len("".join(tokens[:k]).encode())


def test_exceptions():
    for text in ("", "plain", "é", "aé日b😀c", "😀" * 5):
        index = M.Exceptions.of(text.encode())
        assert len(index.at_byte) == sum(ord(c) > 127 for c in text)
        for k in range(len(text) + 1):
            at = len(text[:k].encode())
            assert index.chars(at) == k and index.bytes(k) == at


@pytest.mark.parametrize("seed", ["1", "other"])
def test_seed_decides(spark, seed):
    rows = spark.createDataFrame([(k, "one two three four") for k in range(50)], "doc_id long, text string")
    got = {r.doc_id: r.output for r in M.transformed(rows, seed=seed).collect()}
    assert got == {k: plain(k, "one two three four", seed)[5] for k in range(50)}
