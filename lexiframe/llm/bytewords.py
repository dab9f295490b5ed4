"""Hashes of all words of a batch of texts at once, in numpy, without an object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that are hashed together.
STRETCH = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(STRETCH + 1, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, end) of every word: lower-cased (A-Z) bytes between the six ASCII blanks.

    A word's hash is a polynomial of its bytes, from differences of prefix sums.
    """
    data = np.frombuffer(joined.translate(_LOWER), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BLANK[data]
    edges = np.diff(inside)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _tables()
    hashes = np.zeros(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        # words that lie in one stretch; a longer word is a stretch of its own, hashed piece by piece
        low = begins[at]
        to = int(np.searchsorted(ends, low + STRETCH, "right"))
        if to == at:
            hashes[at] = _long(data[low : ends[at]])
            at += 1
            continue
        high = ends[to - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        first = begins[at:to] - low
        hashes[at:to] = (sums[ends[at:to] - low] - sums[first]) * down[first]
        at = to
    return mix(hashes), begins, ends


def _long(data: np.ndarray) -> np.uint64:
    up, _ = _tables()
    total, shift = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), STRETCH):
            part = data[at : at + STRETCH].astype(np.uint64) + np.uint64(1)
            total = total + (part * up[: len(part)]).sum(dtype=np.uint64) * shift
            shift = shift * up[STRETCH]
    return total


def portions(texts: list[bytes], most_bytes: int = 1 << 20, most_texts: int = 512) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of bounded size; a longer text is a run of its own."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if k > at and (size + len(text) > most_bytes or k - at >= most_texts):
            yield at, k
            at, size = k, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)
