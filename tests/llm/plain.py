"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

AZ = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(AZ)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", lower(text)) if w]


def names(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, window=13):
    """docs, items: (id, text). Per document (id, n_words, n_hit, n_items, sha, contaminated)."""
    grams = defaultdict(set)
    for item, text in items:
        w = names(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams[tuple(w[k : k + window])].add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = names(text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                who = grams.get(tuple(w[k : k + n]))
                if who:
                    hit |= set(range(k, k + n))
                    found |= who
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """sizes: source -> words. Shares above a cap are handed on until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, rest = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = rest - sum(capped.values())
        given = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if given[s] >= most * sizes[s]]
        if not over:
            return capped | given
        capped |= {s: most * sizes[s] for s in over}


def lines(docs):
    """docs: (id, text), ids unique or null. Per document (id, lines, numbers of the lines to remove)."""
    ordered = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    every = [(d, k, frozenset(words(x))) for d, t in ordered for k, x in enumerate((t or "").split("\n"))]
    gone = defaultdict(list)
    earlier = []
    for doc, k, tokens in every:
        if tokens:
            if any(9 * len(tokens & e) >= 4 * (len(tokens) + len(e)) for e in earlier):
                gone[doc].append(k)
            earlier.append(tokens)
    return [(d, (t or "").count("\n") + 1, gone[d]) for d, t in docs]


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_classes(docs):
    """docs: (id, text). id -> smallest id of its class."""
    sets = [shingles(t) for _, t in docs]
    whole = [tuple(words(t)) for _, t in docs]
    parent = list(range(len(docs)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if whole[a] == whole[b] or (sets[a] and sets[b] and both * 5 >= (len(sets[a]) + len(sets[b]) - both) * 4):
                parent[top(a)] = top(b)
    classes = defaultdict(list)
    for k, (doc, _) in enumerate(docs):
        classes[top(k)].append(doc)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in classes.items()}
    return [(doc, least[top(k)], len(classes[top(k)])) for k, (doc, _) in enumerate(docs)]


def remainder(doc, by):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % by


def base_scores(docs):
    """docs: (id, text). Per document (id, tokens, known tokens, training tokens, base score)."""
    tokens = [(d, [*words(t), " "]) for d, t in docs]
    counts = Counter(w for d, ws in tokens if remainder(d, 10) for w in ws)
    total, types = sum(counts.values()), len(counts)
    base = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1)))
    return [(d, len(ws), sum(counts[w] > 0 for w in ws), total, sum(map(base, ws))) for d, ws in tokens]


def class_scores(docs, counts, classes, step, below, strange):
    """docs: (id, text); counts and classes by word. Per document (id, log10 of its class bigram probability)."""
    out = []
    for doc, text in docs:
        before, total = 0, 0.0
        for word in [*words(text), " "]:
            now = classes.get(word, strange)
            total += step[before][now] + math.log10(counts.get(word, 0) + 0.1) - below[now]
            before = now
        out.append((doc, total))
    return out


def best_classes(texts, classes, worth):
    """The likeliest class of every word not in ``classes``, from the classes beside its occurrences."""
    value = defaultdict(lambda: [0.0] * len(worth[0]))
    for text in texts:
        line = [" ", *words(text), " "]
        for k in range(1, len(line) - 1):
            if line[k] not in classes:
                value[line[k]]  # also without a known neighbour
                for c in range(len(worth[0])):
                    if line[k - 1] in classes:
                        value[line[k]][c] += worth[0][classes[line[k - 1]]][c]
                    if line[k + 1] in classes:
                        value[line[k]][c] += worth[1][classes[line[k + 1]]][c]
    return value
