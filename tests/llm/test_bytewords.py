from __future__ import annotations

import random

import numpy as np
import pytest

from lexiframe.llm import bytewords as B


@pytest.mark.parametrize("stretch", [4, 64, 1 << 20])
def test_words_and_hashes(monkeypatch, stretch):
    monkeypatch.setattr(B, "STRETCH", stretch)
    monkeypatch.setattr(B, "_powers", {})
    rng = random.Random(stretch)
    words = [bytes(rng.choice(b"abAB\x00\xc3\xa9.,1") for _ in range(rng.choice([1, 2, 3, 9, 40]))) for _ in range(400)]
    joined = b"\t  " + b"".join(w + rng.choice([b" ", b"\n", b"\r\x0b", b"  "]) for w in words)
    hashes, begins, ends = B.words_of(joined)
    lower = [w.lower() for w in joined.split()]
    assert [joined[a:b].lower() for a, b in zip(begins, ends)] == lower
    by_word = {}
    for word, h in zip(lower, hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_nothing_to_hash():
    for nothing in (b"", b" \n\t "):
        assert [len(x) for x in B.words_of(nothing)] == [0, 0, 0]


def test_hashes_do_not_depend_on_place():
    alone = B.words_of(b"word")[0][0]
    assert (B.words_of(b"x " * 700_000 + b"WORD")[0][-1], B.words_of(b"word other")[0][0]) == (alone, alone)


def test_portions():
    texts = [b"x" * n for n in (5, 5, 0, 50, 1, 1, 1)]
    assert list(B.portions(texts, 10, 512)) == [(0, 3), (3, 4), (4, 7)]
    assert list(B.portions(texts, 1000, 2)) == [(0, 2), (2, 4), (4, 6), (6, 7)]
    assert list(B.portions([])) == []
