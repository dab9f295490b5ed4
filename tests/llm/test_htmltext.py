from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.llm import htmltext as H

PAGES = [
    (1, "u1", "<html><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One   two<br>three <b>fo</b>ur.<p>Five &eacute;.</article>"
     "<footer>&copy; me</footer></body></html>"),
    (2, "u2", None),
    (3, None, ""),
    (None, "u4", "<script>var t = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->"),
    (5, "u5", "<article><p>" + "long words of text, again and again. " * 20_000 + "</p></article>"),
    (6, "u6", "<article><p>unclosed 'quote=\"<b>bold</b> a < b &#55555; &bogus; end"),
    (6, "u6", "<article><p>unclosed 'quote=\"<b>bold</b> a < b &#55555; &bogus; end"),
]


@pytest.fixture(scope="module")
def sampled(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.fixture(scope="module")
def model(sampled):
    return H.fit(sampled, sample=60)


def test_odd_pages(spark, model):
    pages = spark.createDataFrame([(*p, 0, 0) for p in PAGES], "page_id long, url string, html string, text long, n_chars long")
    got = {(r.page_id, r.url): r for r in H.extract(pages, model=model).collect()}
    assert H.extract(pages, model=model).count() == len(PAGES)
    assert got[1, "u1"].text == "A & B One two three four. Five é."
    assert [got[k].text for k in ((2, "u2"), (3, None), (None, "u4"))] == ["", "", ""]
    assert got[5, "u5"].n_chars == len(got[5, "u5"].text) == 20_000 * len("long words of text, again and again. ") - 1
    assert got[6, "u6"].text.startswith("unclosed 'quote=\"bold a < b")
    assert H.extract(pages.limit(0), model=model).count() == 0
    assert H.extract(pages.limit(0)).count() == 0


def test_articles_of_the_given_pages(sampled, model):
    rows = sampled.orderBy(F.md5(F.col("page_id").cast("string")).desc()).limit(100).collect()
    good = 0
    for r in rows:
        inner = r.html.split("<article>")[1].split("</article>")[0]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", inner))).split())
        good += H.main_text(r.html, model) == want
    assert good >= 0.95 * len(rows)


def test_context_and_layouts(model):
    rng = np.random.default_rng(1)
    texts = ["Some words of prose, with a comma and an end.", "Another one. It has two sentences.", "Third text here; it goes on a little while."]
    pages = [H.blocks(H.invented(rng, texts), marked=True) for _ in range(200)]
    labels = np.concatenate([p.labels for p in pages])
    assert (np.concatenate(H.label_blocks(model, pages) ) >= 0.5).astype(int).tolist().count(1) > 0
    assert ((np.concatenate(H.label_blocks(model, pages)) >= 0.5) == (labels == 1)).mean() > 0.97


def test_container_of_deep_blocks(model):
    """What a block is shows only in the outermost elements, however deep it lies."""
    prose = "Some words of prose, with a comma and an end. Another sentence follows it here."
    for depth in (0, 9, 12, 16):
        wrapped = lambda mark, y: f"<{mark} data-y={y}>{'<div>' * depth}" + f"<p>{prose}</p>" * 3 + f"{'</div>' * depth}</{mark}>"
        for order in ((("aside", 0), ("article", 1), ("footer", 0)), (("nav", 0), ("main", 1)), (("article", 1), ("aside", 0))):
            page = H.blocks("<html><body>" + "".join(wrapped(*x) for x in order) + "</body></html>", marked=True)
            assert ((H.label_blocks(model, [page])[0] >= 0.5) == np.array(page.labels)).all(), (depth, order)


def test_many_unclosed_elements(model):
    """A page whose elements are never closed takes no more than its own size."""
    page = H.blocks("<article>" + "<div>word" * 3_000)
    assert len(page.nodes) == 3_002 and page.places == list(range(2, 3_002))
    assert len(H.label_blocks(model, [page])[0]) == 3_000


def test_time_grows_with_the_page():
    """Unclosed elements, closing marks of nothing and list items under them."""
    for unit in ("<div>word", "<p><div>word", "<ul><li>word<div>", "<div>a</span></i>", "<a href=x>word<p>"):
        began = time.time()
        page = H.blocks("<article>" + unit * 50_000)
        assert len(page.texts) == 50_000 or unit.startswith("<a"), unit
        assert time.time() - began < 6, unit


def test_one_long_page_among_small_ones(model, monkeypatch):
    small = [H.blocks(f"<article><p>Some words of prose, number {k}.</p></article><footer>Foot</footer>") for k in range(127)]
    long = H.blocks("<article>" + "<p>Some words of prose here.</p>" * 20_000 + "</article>")
    shapes = []
    padded = H._padded
    monkeypatch.setattr(H, "_padded", lambda *a: shapes.append(padded(*a).shape) or padded(*a))
    chances = H.label_blocks(model, [*small, long])
    assert [len(c) for c in chances] == [2] * 127 + [20_000]
    assert max(a * b for a, b, _ in shapes) <= max(H.MOST_CELLS, 20_000)


def test_own_attributes_are_no_labels(model):
    for value in ("left", "12.5", '"1"', "''", '"0"'):
        page = H.blocks(f"<body><div data-y={value}>Some words of prose, with a comma and an end.</div></body>")
        assert page.labels == [-1]
    assert H.weakly_labelled('<body data-y="left"><article data-y="7">x y z</article></body>')
    marked = H.weakly_labelled("<body><div data-y=left>menu</div><article data-y='2.5'>text</article></body>")
    assert H.blocks(marked, marked=True).labels == [0, 1]


def test_gradients():
    """The way back of the recurrent layer against differences."""
    rng = np.random.default_rng(0)
    width, pages, steps = 5, 3, 4
    gates = rng.normal(0, 0.5, (width + H.HIDDEN + 1, 4 * H.HIDDEN))
    x = rng.normal(0, 1, (pages, steps, width))
    weight = rng.normal(0, 1, (pages, steps, H.HIDDEN))
    value = lambda: float((H._read(gates, x)[0].astype(np.float64) * weight).sum())
    grad, grad_x = H._read_back(gates, x, H._read(gates, x, keep=True)[1], weight)
    for array, got, at in ((gates, grad, (2, 7)), (gates, grad, (width + 3, 20)), (gates, grad, (-1, 40)), (x, grad_x, (1, 2, 3))):
        kept = array[at]
        array[at] = kept + 1e-3
        up = value()
        array[at] = kept - 1e-3
        down = value()
        array[at] = kept
        assert abs((up - down) / 2e-3 - got[at]) < 2e-2
