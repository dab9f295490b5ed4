from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

PROSE = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon "
    "phi chi psi omega one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
)
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(40_000))
DOCS = [
    (1, PROSE, "a"),
    (2, PROSE.upper(), "a"),
    (3, PROSE.replace("omega", "OMEGAS"), "b"),
    (4, "", "b"),
    (5, None, None),
    (6, "  \t\n ", "c"),
    (7, "Ünïcode ÄÖ wörter\nzweite Zeile mit Wörtern\n" + PROSE, None),
    (8, LONG, "c"),
    (9, LONG + " more", "a"),
    (10, "a b", "a"),
    (11, "a b c", "a"),
    (12, "a b c d", "b"),
    (13, "a b c d e", "b"),
    (14, "same line of words here now\nsame line of words here now\nother", "d"),
    (15, "same line of words here now then\nnothing like it", "d"),
    (16, "\x00null byte\x1f and   separators\r\nwindows line", "d"),
    (17, " ".join(["word"] * 300), "d"),
    (None, "no id here but some words in it", "a"),
    (None, "no id here either, other words though", "e"),
    (20, PROSE, "z"),
    (20, PROSE, "z"),
]
#: Names that the operators use inside.
CLASHES = (
    "size row digest block score class n key slot shard copies copy place label virtual_slot version cell bits maybe best rep band "
    "hub members token line first n_words items s u source_size target text_sha256 label_id c0 c1 page record"
).split()


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), *range(len(CLASHES))) for i, t, s in DOCS]
    clashing = ", ".join(f"`{c}` long" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clashing}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def pairs():
    return [(i, t) for i, t, _ in DOCS]
