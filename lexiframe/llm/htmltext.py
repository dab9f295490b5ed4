"""Main text of web pages by a recurrent block labeller, in numpy.

A page is cut into leaf blocks. Each block becomes a vector of its tag path, its
words (both hashed into learned tables) and a few measures. A bidirectional LSTM
reads the blocks of the whole page in order, so a block is judged by what stands
before and after it, and a logistic unit labels it as main text or not.

No page comes with labels. The network is trained on a bounded sample of pages: as
they are where they name their parts by tags, and their texts again in many
invented layouts whose parts are known.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound on the sample of pages the network is trained on, and on the html of one of them.
SAMPLE_PAGES, SAMPLE_BYTES = 240, 65_536
#: Invented layouts in the training set.
LAYOUTS = 960
TAGS, WORDS, WIDTH, HIDDEN, MEASURES = 512, 2048, 12, 16, 6
EPOCHS, BATCH, RATE = 6, 16, 0.01
#: Blocks of pages that are read side by side.
STRIDE = 128
#: Blocks times pages that are read side by side; a page with more blocks is read alone.
MOST_CELLS = 16_384

# -- pages to blocks -------------------------------------------------------

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^>])*+)(?:>|\Z)""",
    re.S,
)
#: The attribute that carries a label on pages marked for training.
LABEL = "data-y"
_NAMES = re.compile(r"""\b(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PIECES = re.compile(r"[a-z]+|\d", re.I)
_WORDS = re.compile(r"\w+|[^\w\s]")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q ruby s samp small span strike strong sub "
    "sup time tt u var wbr img".split()
)
#: Their content is no text of the page.
RAW = set("script style noscript template textarea title svg math iframe object select head xmp noembed noframes".split())
_PARAGRAPH_ENDS = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


@dataclass
class Page:
    texts: list[str] = field(default_factory=list)
    nodes: list[tuple[int, int, tuple[int, ...]]] = field(default_factory=list)  # elements: the one around, depth, hashed names
    places: list[int] = field(default_factory=list)  # innermost open element of each block
    linked: list[float] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)


def _hash(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def blocks(source: str, marked: bool = False) -> Page:
    """The leaf blocks of a page: text between marks that begin or end a block.

    References are decoded, white space becomes one space, blocks without text are
    left out. Tags that were never closed end with their surroundings. Pages ``marked``
    for training carry labels in an attribute; on others it means nothing.
    """
    page, stack = Page(nodes=[(-1, 0, ())]), [("#", 0, -1)]  # (tag, element, label)
    open_at: dict[str, list[int]] = defaultdict(list)  # places of a tag's open elements in the stack

    def innermost(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at[t]), default=0)

    def close(k):
        for tag, *_ in stack[k:]:
            open_at[tag].pop()
        del stack[k:]

    parts: list[str] = []
    linked, links = 0, 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                page.texts.append(text)
                page.places.append(stack[-1][1])
                page.linked.append(min(1.0, linked / len(text)))
                page.labels.append(stack[-1][2])
            parts.clear()
        linked = 0

    def add(text):
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) * (links > 0)

    at, end = 0, len(source)
    while at < end:
        mark = _MARK.search(source, at)
        if not mark:
            add(source[at:])
            break
        add(source[at : mark.start()])
        at = mark.end()
        tag = mark[2]
        if tag is None:
            if mark[0].startswith("<![CDATA["):
                add(mark[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if mark[1]:
            if tag not in INLINE:
                flush()
            k = innermost([tag])
            if k:
                if innermost("a") >= k:
                    links = 0
                close(k)
            continue
        if tag in RAW:
            if not mark[3].endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                if tag == "head" and not shut:
                    shut = re.compile(r"(?=<body\b)", re.I).search(source, at)
                at = shut.end() if shut else at if tag in ("head", "svg", "math", "object", "select") else end
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if tag in _PARAGRAPH_ENDS and open_at["p"]:
            close(open_at["p"][-1])
            links = 0
        elif tag in _CLOSES and innermost(_CLOSES[tag]) > innermost(_HOLDS[tag]):
            close(innermost(_CLOSES[tag]))
        names, label = [_hash("<" + tag, TAGS)], stack[-1][2]
        if "=" in mark[3]:
            for kind, value in _NAMES.findall(mark[3]):
                if kind == LABEL:
                    label = int(value.strip("\"'")) if marked else label
                else:
                    names += [_hash(x.lower(), TAGS) for x in _PIECES.findall(value)]
        if tag == "a":
            links = 1
        page.nodes.append((stack[-1][1], len(stack), tuple(names)))
        open_at[tag].append(len(stack))
        stack.append((tag, len(page.nodes) - 1, label))
    flush()
    return page


# -- blocks to vectors -----------------------------------------------------


def _measures(page: Page) -> np.ndarray:
    sizes = np.array([len(t) for t in page.texts], np.float32)
    marks = np.array([sum(t.count(c) for c in ".,;!?") for t in page.texts], np.float32)
    place = np.arange(len(sizes), dtype=np.float32)
    return np.stack(
        [
            np.log1p(sizes) / 5, np.array(page.linked, np.float32), np.minimum(1, 20 * marks / (sizes + 1)),
            np.exp(-place / 3), np.exp(-place[::-1] / 3), np.ones_like(sizes),
        ],
        axis=1,
    )


def _bags(lists: list[Iterable[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed names as one flat array, the list each belongs to, and one over each list's length."""
    lengths = np.array([len(x) for x in lists])
    flat = np.fromiter((y for x in lists for y in x), np.int64, int(lengths.sum()))
    return flat, np.repeat(np.arange(len(lists)), lengths), (1 / np.maximum(lengths, 1)).astype(np.float32)


@dataclass
class Model:
    tags: np.ndarray  # TAGS x WIDTH
    words: np.ndarray  # WORDS x WIDTH
    gates: list[np.ndarray]  # per direction (inputs + HIDDEN + 1) x 4 HIDDEN
    out: np.ndarray  # 2 HIDDEN + 1

    def parts(self):
        return [self.tags, self.words, *self.gates, self.out]


def _tree(pages: list[Page]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Elements of all pages by depth, outermost ones left out; the element around each; the innermost one of each block."""
    begins = np.cumsum([0, *(len(page.nodes) for page in pages)])
    around = np.array([k + at for page, at in zip(pages, begins) for k, _, _ in page.nodes])
    depth = np.array([d for page in pages for _, d, _ in page.nodes])
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[1:]
    return levels, around, np.array([k + at for page, at in zip(pages, begins) for k in page.places])


def _inputs(model: Model, pages: list[Page]):
    """Inputs of all blocks. The path of a block is the sum over all elements that are open around it."""
    tags = _bags([names for page in pages for _, _, names in page.nodes])
    tree = levels, around, places = _tree(pages)
    words = _bags([[_hash(w.lower(), WORDS) for w in _WORDS.findall(t)] for page in pages for t in page.texts])
    columns = []
    for table, (flat, owner, weight) in ((model.tags, tags), (model.words, words)):
        summed = np.zeros((len(weight), WIDTH), np.float32)
        if len(flat):
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            summed[owner[begins]] = np.add.reduceat(table[flat], begins, axis=0)
        if table is model.tags:
            for level in levels:
                summed[level] += summed[around[level]]
            columns.append(summed[places])
        else:
            columns.append(summed * weight[:, None])
    measures = np.concatenate([_measures(page) for page in pages])
    return np.concatenate([*columns, measures], axis=1), tags, words, tree


def _padded(rows: np.ndarray, lengths: list[int], back: bool) -> np.ndarray:
    """pages x longest x inputs; the reading direction runs forward in time either way."""
    out = np.zeros((len(lengths), max(lengths), rows.shape[1]), np.float32)
    at = 0
    for k, n in enumerate(lengths):
        out[k, :n] = rows[at : at + n][::-1] if back else rows[at : at + n]
        at += n
    return out


def _flat(padded: np.ndarray, lengths: list[int], back: bool) -> np.ndarray:
    return np.concatenate([x[:n][::-1] if back else x[:n] for x, n in zip(padded, lengths)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _read(gates: np.ndarray, x: np.ndarray, keep: bool = False):
    """Run one direction. Returns the states and, to train, what the way back needs."""
    pages, steps, width = x.shape
    drive = x @ gates[:width] + gates[-1]
    recur = gates[width:-1]
    h = np.zeros((pages, HIDDEN), np.float32)
    c = np.zeros_like(h)
    states = np.zeros((pages, steps, HIDDEN), np.float32)
    trace = []
    for t in range(steps):
        z = drive[:, t] + h @ recur
        ifo = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, prior = c, h
        c = ifo[:, HIDDEN : 2 * HIDDEN] * c + ifo[:, :HIDDEN] * g
        squashed = np.tanh(c)
        h = ifo[:, 2 * HIDDEN :] * squashed
        states[:, t] = h
        if keep:
            trace.append((ifo, g, before, prior, squashed))
    return states, trace


def _read_back(gates: np.ndarray, x: np.ndarray, trace: list, grad_states: np.ndarray):
    """Gradients of one direction for its gates and inputs."""
    width = x.shape[2]
    recur = gates[width:-1]
    grad_gates = np.zeros_like(gates)
    grad_x = np.zeros_like(x)
    grad_h = np.zeros((x.shape[0], HIDDEN), np.float32)
    grad_c = np.zeros_like(grad_h)
    for t in range(x.shape[1] - 1, -1, -1):
        ifo, g, before, prior, squashed = trace[t]
        i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
        grad_h = grad_h + grad_states[:, t]
        grad_c = grad_c + grad_h * o * (1 - squashed**2)
        z = np.concatenate(
            [grad_c * g * i * (1 - i), grad_c * before * f * (1 - f), grad_h * squashed * o * (1 - o), grad_c * i * (1 - g**2)],
            axis=1,
        )
        grad_gates[:width] += x[:, t].T @ z
        grad_gates[width:-1] += prior.T @ z
        grad_gates[-1] += z.sum(0)
        grad_x[:, t] = z @ gates[:width].T
        grad_h = z @ recur.T
        grad_c = grad_c * f
    return grad_gates, grad_x


def label_blocks(model: Model, pages: list[Page]) -> list[np.ndarray]:
    """Probability of main text for every block. Pages of like length are read side by side."""
    out = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k].texts), key=lambda k: len(pages[k].texts))
    while order:
        side = 1  # pages as long as the longest of them, in a table of bounded size
        while side < min(STRIDE, len(order)) and (side + 1) * len(pages[order[side]].texts) <= MOST_CELLS:
            side += 1
        group, order = order[:side], order[side:]
        lengths = [len(pages[k].texts) for k in group]
        rows, *_ = _inputs(model, [pages[k] for k in group])
        states = np.concatenate(
            [_flat(_read(g, _padded(rows, lengths, back))[0], lengths, back) for g, back in zip(model.gates, (False, True))], axis=1
        )
        chance = _sigmoid(states @ model.out[:-1] + model.out[-1])
        for k, part in zip(group, np.split(chance, np.cumsum(lengths)[:-1])):
            out[k] = part
    return out


# -- training --------------------------------------------------------------

_MAIN_TAGS = ("article", "main")
_OTHER_TAGS = ("nav", "footer", "aside", "form", "header")


def weakly_labelled(source: str) -> str | None:
    """A page that names its main part by a tag, marked for training; else nothing."""
    if not any(f"<{t}" in source for t in _MAIN_TAGS):
        return None
    mark = lambda tags, y, s: re.sub(rf"<({'|'.join(tags)})\b", rf'<\1 data-y="{y}"', s, flags=re.I)
    source = re.sub(rf"\b{LABEL}\s*=", "data-other=", source, flags=re.I)
    return mark(_OTHER_TAGS, 0, mark(_MAIN_TAGS, 1, re.sub(r"<body\b", '<body data-y="0"', source, flags=re.I)))


_SHELLS = (  # opening and closing marks around the main text
    "<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post">', '<div class="entry-content">',
    '<div class="article-body">', '<div id="story">', '<section class="article">', '<div role="main">', "<main><article>",
    '<div class="container"><article class="post">', '<div class="page"><div class="text">', "<div>", "<div><div>", "<section>",
    '<table><tr><td class="content">',
)
_ASIDES = (  # other parts of a page: marks, how many pieces, of which kind
    ("<nav><ul>", "li", 6), ('<div class="menu"><ul>', "li", 6), ('<ul class="navbar">', "li", 5), ('<div id="nav">', "a", 5),
    ("<header>", "h", 2), ('<div class="header">', "h", 2), ('<div id="masthead">', "h", 1), ("<footer>", "s", 2),
    ('<div class="footer">', "s", 2), ('<div id="footer"><ul>', "li", 4), ('<div class="copyright">', "s", 1),
    ("<aside>", "p", 3), ('<div class="sidebar">', "p", 3), ('<div id="sidebar"><ul>', "li", 5), ('<div class="widget">', "li", 3),
    ('<div class="ad">', "s", 1), ('<div class="ads">', "s", 1), ('<div class="advert">', "s", 1), ('<div class="advertisement">', "p", 1),
    ('<div class="banner">', "s", 1), ('<div class="promo">', "s", 1), ('<div class="sponsored">', "p", 2), ('<section class="ad-slot">', "s", 1),
    ('<div class="cookie-notice">', "p", 1), ('<div class="notice">', "s", 1), ('<div id="cookies" class="consent">', "p", 1),
    ('<div class="alert">', "s", 1), ('<div class="popup modal">', "p", 1), ('<form action="/search">', "f", 2),
    ('<form class="newsletter">', "f", 2), ('<div class="subscribe"><form>', "f", 2), ('<section class="comments">', "p", 4),
    ('<div id="comments">', "p", 4), ('<ol class="comment-list">', "li", 4), ('<div class="comment">', "p", 2),
    ('<div class="related">', "li", 4), ('<div class="share social">', "a", 4), ('<div class="breadcrumbs">', "a", 3),
    ('<div class="pagination">', "a", 4), ('<div class="tags">', "a", 4), ('<div class="login">', "f", 2),
)


#: Marks around parts of a page that say nothing about them.
_WRAPS = ("<div>", "<div>", "<div>", "<section>", "<span>", "<b>", '<div class="row">', '<div class="col">')


def _closing(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<([a-z0-9]+)", opening)))


def invented(rng: np.random.Generator, texts: list[str]) -> str:
    """A page of an invented layout around given texts, every part marked with its label."""
    pick = lambda: texts[rng.integers(len(texts))]
    short = lambda: " ".join(pick().split()[: rng.integers(1, 8)])
    wild = "".join(chr(97 + x) for x in rng.integers(0, 26, 5))

    def wraps(most):
        return "".join(_WRAPS[k] for k in rng.integers(0, len(_WRAPS), rng.integers(1, most + 1))) if rng.random() < 0.4 else ""

    def other():
        opening, kind, most = _ASIDES[rng.integers(len(_ASIDES))]
        close = _closing(opening)
        opening = re.sub(r"<(\w+)", r'<\1 data-y="0"', opening, count=1)
        made = {
            "li": lambda: f"<li><a href='#'>{short()}</a></li>", "a": lambda: f"<a href='#'>{short()}</a> ", "h": lambda: f"<h1>{short()}</h1>",
            "s": lambda: short() + " " + short(), "p": lambda: f"<p>{html.escape(pick()[:300])}</p>",
            "f": lambda: f"<label>{short()}</label><input><button>{short()}</button>",
        }[kind]
        inside = wraps(12)
        return opening + inside + "".join(made() for _ in range(rng.integers(1, most + 2))) + _closing(inside) + close

    def main():
        out = [f"<h1>{short()}</h1>"] if rng.random() < 0.7 else []
        for _ in range(rng.integers(1, 8)):
            kind = rng.random()
            text = html.escape(pick())
            if kind < 0.7:
                out.append(f"<p>{text}</p>")
            elif kind < 0.78:
                out.append(f"<h2>{short()}</h2>")
            elif kind < 0.84:
                out.append("<ul>" + "".join(f"<li>{short()} {short()}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.95:
                out.append(f"<p>{short()} <a href='#'>{short()}</a> {text}</p>")
            else:
                out.append(f"<div>{text}</div>")
            if rng.random() < 0.08:
                out.append(other())
        return "".join(out)

    shell = _SHELLS[rng.integers(len(_SHELLS))] if rng.random() < 0.9 else f'<div class="{wild}">'
    opening = re.sub(r"<(\w+)", r'<\1 data-y="1"', shell, count=1)
    before = "".join(other() for _ in range(rng.integers(0, 4)))
    after = "".join(other() for _ in range(rng.integers(0, 4)))
    around, inside = wraps(8), wraps(12)
    body = f"{around}{before}{opening}{inside}{main()}{_closing(inside)}{_closing(shell)}{after}{_closing(around)}"
    return f'<html><head><title>{short()}</title></head><body data-y="0">{body}</body></html>'


def train(pages: list[str], seed: int = 5) -> Model:
    """Fit on sampled pages as they are and in invented layouts."""
    rng = np.random.default_rng(seed)
    inputs = 2 * WIDTH + MEASURES
    gates = [rng.normal(0, 0.15, (inputs + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32) for _ in range(2)]
    for g in gates:
        g[-1] = 0
        g[-1, HIDDEN : 2 * HIDDEN] = 1  # remember at first
    model = Model(
        rng.normal(0, 0.2, (TAGS, WIDTH)).astype(np.float32), rng.normal(0, 0.05, (WORDS, WIDTH)).astype(np.float32),
        gates, rng.normal(0, 0.2, 2 * HIDDEN + 1).astype(np.float32),
    )
    texts = [t for p in pages for t in blocks(p).texts if t.strip()]
    texts = texts or ["One two three four five.", "Six seven, eight nine ten eleven twelve.", "Menu", "Read more about this."]
    marked = [m for m in map(weakly_labelled, pages) if m]
    marked += [invented(rng, texts) for _ in range(LAYOUTS)]
    examples = [p for p in (blocks(m, marked=True) for m in marked) if p.texts and min(p.labels) >= 0]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parts()]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            group = [examples[k] for k in order[at : at + BATCH]]
            lengths = [len(p.texts) for p in group]
            rows, tags, words, (levels, around, places) = _inputs(model, group)
            rows[:, WIDTH : 2 * WIDTH] *= rng.random((len(rows), 1)) < 0.5  # do not lean on words
            rows[:, :WIDTH] *= rng.random((len(rows), 1)) < 0.9
            padded = [_padded(rows, lengths, back) for back in (False, True)]
            runs = [_read(g, x, keep=True) for g, x in zip(model.gates, padded)]
            flat = np.concatenate([_flat(s, lengths, back) for (s, _), back in zip(runs, (False, True))], axis=1)
            target = np.array([y for p in group for y in p.labels], np.float32)
            error = (_sigmoid(flat @ model.out[:-1] + model.out[-1]) - target) / len(target)
            grad_out = np.append(flat.T @ error, error.sum())
            grad_flat = error[:, None] * model.out[:-1]
            grad_rows, grad_gates = np.zeros_like(rows), []
            for k, back in enumerate((False, True)):
                grad_states = _padded(grad_flat[:, k * HIDDEN : (k + 1) * HIDDEN], lengths, back)
                gg, gx = _read_back(model.gates[k], padded[k], runs[k][1], grad_states)
                grad_gates.append(gg)
                grad_rows += _flat(gx, lengths, back)
            grad_rows *= rows != 0
            elements = np.zeros((len(around), WIDTH), np.float32)
            np.add.at(elements, places, grad_rows[:, :WIDTH])
            for level in reversed(levels):
                np.add.at(elements, around[level], elements[level])
            tables = []
            for table, (names, owner, _), rise in (
                (model.tags, tags, elements), (model.words, words, grad_rows[:, WIDTH : 2 * WIDTH] * words[2][:, None])
            ):
                grad = np.zeros_like(table)
                np.add.at(grad, names, rise[owner])
                tables.append(grad)
            step += 1
            rate = RATE * (0.3 if epoch >= EPOCHS - 2 else 1)
            for part, grad, (m, v) in zip(model.parts(), [*tables, *grad_gates, grad_out], moments):
                grad = grad + 1e-5 * part
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Model:
    """Fit on the ``sample`` pages, at most SAMPLE_BYTES long each, whose ids hash smallest."""
    short = pages.filter(F.octet_length(pages[html_col]).between(1, SAMPLE_BYTES))
    ids = short.select(short[id_col].alias("id"), F.md5(short[id_col].cast("string")).alias("h")).distinct()
    few = ids.orderBy("h", "id").limit(sample).select("id")
    rows = short.select(short[id_col].alias("id"), short[html_col].alias("html")).join(F.broadcast(few), "id").limit(2 * sample)
    found = sorted((str(r.id), r.html) for r in rows.collect())
    return train([h for _, h in found])


# -- operator --------------------------------------------------------------


def main_text(source: str | None, model: Model) -> str:
    """The main text of one page."""
    page = blocks(source or "")
    return _joined(page, label_blocks(model, [page])[0])


def _joined(page: Page, chances: np.ndarray) -> str:
    return " ".join(t for t, c in zip(page.texts, chances) if c >= 0.5)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty html gives an empty text, as does a page without main text.
    Repeated rows give repeated results; page and url pass through, null or not.
    Only the named columns are read. An empty table gives an empty result.
    """
    model = model or fit(pages, id_col, html_col)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [blocks(h or "") for h in batch.column(2).to_pylist()]
            texts = [_joined(p, c) for p, c in zip(cut, label_blocks(model, cut))]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # references to lone surrogates
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    done = rows.mapInArrow(run, schema)
    return done.withColumn("n_chars", F.char_length("text").cast("long"))
