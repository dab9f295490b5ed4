"""Pieces of the checking SQL (DuckDB). Written apart from the Spark side; only word lists are shared."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from lexiframe.functions import lexicons
from lexiframe.functions.stopwords import WORDS, stopwords

WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
SENTENCE = r"[^.!?]+[.!?]*"
SENTENCE_PIECE = r"[^.!?]*[.!?]+|[^.!?]+"
PIECE = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: Iterable[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def mapped(table: Mapping[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items()) + "}"


def is_stop(word: str = "lower(text)", lang: str = "lang") -> str:
    branches = " ".join(
        f"WHEN {quoted(code)} THEN {word} IN {listed(stopwords(code))}"
        for code in WORDS
    )
    return f"(CASE {lang} {branches} ELSE false END)"


def blank(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_matches({c}, '[^{WS}]'))"


def collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'))"


def rounded(x: str, digits: int = 2) -> str:
    """Correct rounding of the binary value, by way of its printed form."""
    return f"CAST(format('{{:.{digits}f}}', {x}) AS DOUBLE)"


NOISY_CASES = """CASE doc_id % 6
         WHEN 0 THEN concat('<p class="x">', text, '</p> BTW idk')
         WHEN 1 THEN concat(text, ' see https://x.io/', CAST(doc_id AS {string}), ' don''t')
         WHEN 2 THEN concat('  "', text, '" at 10:30 in room_5 ')
         WHEN 3 THEN concat('TGIF www.site.com/x ', text)
         WHEN 4 THEN concat('\U0001f600 ', text, ' it''s \U0001f44d\U0001f525')
         ELSE text END"""
NOISY = f"noisy AS (SELECT doc_id, lang, {NOISY_CASES.format(string='VARCHAR')} AS text FROM documents)"


def contractions(c: str) -> str:
    key = "lower(replace(p, '’', ''''))"
    return (
        f"array_to_string(list_transform(regexp_extract_all({c}, {quoted(PIECE)}),"
        f" lambda p: coalesce({mapped(lexicons.contractions())}[{key}], p)), '')"
    )


def chat_words(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({collapsed(c)}, ' '),"
        f" lambda w: coalesce({mapped(lexicons.CHAT_WORDS)}[upper(w)], w)), ' ')"
    )


def demojized(c: str) -> str:
    """The emoji the noise view contains."""
    for char, name in (("\U0001f600", "grinning_face"), ("\U0001f44d", "thumbs_up"), ("\U0001f525", "fire")):
        c = f"replace({c}, '{char}', ':{name}:')"
    return c


def without_urls(c: str) -> str:
    return rf"regexp_replace({c}, 'https?://[^{WS}]+|www\.[^{WS}]+', '', 'g')"


def normalized(c: str) -> str:
    """Nested calls, innermost step first."""
    c = without_urls(f"regexp_replace(lower({c}), '<.*?>', '', 'g')")
    c = demojized(chat_words(contractions(c)))
    return collapsed(f"translate(translate({c}, ':_', '  '), '\"''', '')")


def tokens(source: str = "documents", extra: str = "") -> str:
    """CTEs ``pieces``, ``toks`` with the base fields of every token."""
    return f"""
pieces AS (
  SELECT doc_id, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) - 1 AS sent_id
  FROM (SELECT doc_id, lang, regexp_extract_all(text, {quoted(SENTENCE_PIECE)}) AS ps FROM {source})),
cut AS (
  SELECT doc_id, lang, sent_id, unnest(ts) AS text, generate_subscripts(ts, 1) AS k
  FROM (SELECT *, regexp_extract_all(piece, {quoted(TOKEN)}) AS ts FROM pieces)),
toks AS (
  SELECT doc_id, lang, CAST(sent_id AS INTEGER) AS sent_id, text, lower(text) AS lower,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, k) - 1 AS INTEGER) AS tok_id,
         regexp_matches(text, '^\\p{{L}}+$') AS is_alpha, {is_stop()} AS is_stop
  FROM cut)"""


def pos_case() -> str:
    branches = [
        r"WHEN regexp_matches(text, '^\p{N}+$') THEN 'NUM'",
        r"WHEN regexp_matches(text, '^\p{P}$') THEN 'PUNCT'",
        "WHEN NOT is_alpha THEN 'SYM'",
    ]
    for pos, words in lexicons.POS_WORDS.items():
        branches.append(f"WHEN lower IN {listed(words.split())} THEN '{pos}'")
    for pos, ends in lexicons.POS_SUFFIXES:
        test = " OR ".join(f"(lower LIKE '%{e}' AND length(lower) >= {len(e) + 2})" for e in ends)
        branches.append(f"WHEN {test} THEN '{pos}'")
    return f"CASE {' '.join(branches)} ELSE 'X' END"


def lemma_case() -> str:
    verbs = listed(lexicons.POS_WORDS["VERB"].split())
    irregular = mapped(lexicons.LEMMAS)
    stem = "regexp_replace(lower, '(ing|ed)$', '')"
    return f"""CASE
      WHEN {irregular}[lower] IS NOT NULL THEN {irregular}[lower]
      WHEN regexp_matches(lower, '^.{{3,}}ies$') THEN regexp_replace(lower, 'ies$', 'y')
      WHEN regexp_matches(lower, '^.{{2,}}sses$') THEN regexp_replace(lower, 'es$', '')
      WHEN regexp_matches(lower, '^.{{2,}}[^siu]s$') AND pos IN ('NOUN', 'VERB', 'X')
        THEN regexp_replace(lower, 's$', '')
      WHEN pos = 'VERB' AND regexp_matches(lower, '(ing|ed)$') AND {stem} IN {verbs} THEN {stem}
      WHEN pos = 'VERB' AND regexp_matches(lower, '(ing|ed)$') AND {stem} || 'e' IN {verbs} THEN {stem} || 'e'
      ELSE lower END"""


MORPH_CASE = """CASE
      WHEN pos = 'VERB' AND lower LIKE '%ing' THEN 'Tense=Pres|VerbForm=Part'
      WHEN pos = 'VERB' AND lower LIKE '%ed' THEN 'Tense=Past|VerbForm=Fin'
      WHEN pos = 'VERB' THEN 'VerbForm=Inf'
      WHEN pos = 'NOUN' AND regexp_matches(lower, '[^su]s$') THEN 'Number=Plur'
      WHEN pos = 'NOUN' THEN 'Number=Sing'
      WHEN pos = 'ADJ' THEN 'Degree=Pos'
      ELSE '' END"""


def annotated(source: str = "documents") -> str:
    """Adds CTE ``ann`` with pos, lemma and morph."""
    return f"""{tokens(source)},
tagged AS (SELECT *, {pos_case()} AS pos FROM toks),
ann AS (SELECT *, {lemma_case()} AS lemma, {MORPH_CASE} AS morph FROM tagged)"""


def parsed(source: str = "documents") -> str:
    """Adds CTE ``dep`` with label and head by position."""
    return f"""{annotated(source)},
rooted AS (
  SELECT *, coalesce(
      min(CASE WHEN pos IN ('VERB', 'AUX') THEN tok_id END) OVER s,
      min(CASE WHEN is_alpha THEN tok_id END) OVER s,
      min(tok_id) OVER s) AS head_tok_id
  FROM ann WINDOW s AS (PARTITION BY doc_id, sent_id)),
dep AS (
  SELECT *, CASE
      WHEN tok_id = head_tok_id THEN 'ROOT'
      WHEN lower IN {listed(lexicons.NEGATION_CUES)} THEN 'neg'
      WHEN pos IN ('PUNCT', 'SYM') THEN 'punct'
      WHEN pos IN ('NOUN', 'PRON', 'X') AND tok_id < head_tok_id THEN 'nsubj'
      WHEN pos IN ('NOUN', 'PRON', 'X') THEN 'dobj'
      WHEN pos = 'ADJ' THEN 'amod'
      WHEN pos = 'DET' THEN 'det'
      WHEN pos = 'ADP' THEN 'prep'
      WHEN pos = 'ADV' THEN 'advmod'
      ELSE 'dep' END AS dep
  FROM rooted)"""


def content_words(source: str = "documents") -> str:
    """Adds CTEs ``kept`` (content words with positions) and ``freq``."""
    return f"""{tokens(source)},
kept AS (
  SELECT doc_id, lower AS word, tok_id,
         row_number() OVER (PARTITION BY doc_id ORDER BY tok_id) AS p
  FROM toks WHERE is_alpha AND NOT is_stop),
freq AS (SELECT doc_id, word, count(*) AS n FROM kept GROUP BY 1, 2)"""


def phrase_scores(source: str = "documents") -> str:
    """Adds ``runs``, ``phrases`` with their words, cosine and summed counts."""
    return f"""{content_words(source)},
islands AS (SELECT *, tok_id - p AS island FROM kept),
runs AS (
  SELECT doc_id, island, min(p) AS first_p, count(*) AS n,
         string_agg(word, ' ' ORDER BY p) AS phrase
  FROM islands GROUP BY 1, 2 HAVING count(*) > 1),
phrases AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_p) - 1 AS INTEGER) AS phrase_idx
  FROM runs),
doc_norm AS (
  SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm, max(n) AS top FROM freq GROUP BY 1),
phrase_words AS (
  SELECT i.doc_id, i.island, i.word, count(*) AS k FROM islands i
  JOIN phrases USING (doc_id, island) GROUP BY 1, 2, 3),
sums AS (
  SELECT w.doc_id, w.island, sum(w.k * f.n) AS dot, sqrt(CAST(sum(w.k * w.k) AS DOUBLE)) AS norm
  FROM phrase_words w JOIN freq f USING (doc_id, word) GROUP BY 1, 2)"""


EDGES = """links AS (
  SELECT DISTINCT a.doc_id, least(a.word, b.word) AS src, greatest(a.word, b.word) AS dst
  FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p + 1 AND a.p + 3)"""

PAGERANK = f"""{EDGES},
arcs AS (SELECT doc_id, src, dst FROM links UNION SELECT doc_id, dst, src FROM links),
degree AS (SELECT doc_id, src AS node, count(*) AS k FROM arcs GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS n FROM degree GROUP BY 1),
rounds AS (
  SELECT 0 AS i, d.doc_id, d.node, 1.0::DOUBLE / s.n AS x, s.n, d.k, 1e9::DOUBLE AS err
  FROM degree d JOIN sizes s USING (doc_id)
  UNION ALL
  SELECT i, doc_id, node, x, n, k, sum(abs(x - old)) OVER (PARTITION BY doc_id) AS err
  FROM (
    SELECT r.i + 1 AS i, r.doc_id, a.dst AS node, 0.85 * sum(r.x / r.k) + 0.15 / any_value(r.n) AS x,
           any_value(r.n) AS n, any_value(t.k) AS k, any_value(t.x) AS old
    FROM rounds r
    JOIN arcs a ON a.doc_id = r.doc_id AND a.src = r.node
    JOIN rounds t ON t.doc_id = a.doc_id AND t.node = a.dst
    WHERE r.i < 100 AND r.err >= r.n * 1e-6
    GROUP BY r.i, r.doc_id, a.dst)),
ranked AS (
  SELECT doc_id, node, x FROM (
    SELECT *, max(i) OVER (PARTITION BY doc_id) AS last FROM rounds) WHERE i = last)"""
