"""Queries on text: normalisation, tokens, linguistics, phrases, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions import linguistics as L
from lexiframe.functions import normalize as N
from lexiframe.functions import tokens as T
from lexiframe.functions.sqlfuncs import register_functions
from lexiframe.functions.stopwords import WORDS
from lexiframe.operators import enrich as E
from lexiframe.operators import hooks as H
from lexiframe.operators import keyphrases as K
from lexiframe.operators import linguistics as O
from lexiframe.plans import sqltext as S
from lexiframe.plans import toys
from lexiframe.plans.registry import query, table


def toks() -> Column:
    return F.col(O.TOKENS)


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


def noisy(spark, sf) -> DataFrame:
    """Documents with markup, links, shorthand, contractions, quotes and emoji put in."""
    docs = documents(spark, sf)
    text = F.expr(S.NOISY_CASES.format(string="STRING").replace("''", "\\'"))
    return docs.select("doc_id", "lang", text.alias("text"))


def tokened(spark, sf, **options) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    return O.with_tokens(docs, "text", "lang", **options)


def worded(spark, sf) -> DataFrame:
    return O.with_content_words(documents(spark, sf), "text", "lang").select("doc_id", O.WORDS_COLUMN)


# --- normalisation -------------------------------------------------------


@query(
    "null_to_empty",
    "SELECT doc_id, coalesce(CASE WHEN doc_id % 7 <> 0 THEN text END, '') AS value FROM documents",
)
def _(spark, sf):
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    return documents(spark, sf).select("doc_id", N.null_to_empty(text).alias("value"))


@query(
    "lower_strip",
    f"""WITH {S.NOISY}
    SELECT doc_id, lower(regexp_replace(text, '^[{S.WS}]+|[{S.WS}]+$', '', 'g')) AS value FROM noisy""",
)
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.lower_strip(F.col("text")).alias("value"))


@query(
    "strip_html",
    "SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS value FROM pages",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.strip_html(F.col("html")).alias("value"))


@query("strip_urls", f"WITH {S.NOISY} SELECT doc_id, {S.without_urls('text')} AS value FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.strip_urls(F.col("text")).alias("value"))


@query(
    "expand_contractions",
    f"WITH {S.NOISY} SELECT doc_id, {S.contractions('text')} AS value FROM noisy",
)
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.expand_contractions(F.col("text")).alias("value"))


@query("expand_chat_words", f"WITH {S.NOISY} SELECT doc_id, {S.chat_words('text')} AS value FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.expand_chat_words(F.col("text")).alias("value"))


@query("demojize", f"WITH {S.NOISY} SELECT doc_id, {S.demojized('text')} AS value FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.demojize(F.col("text")).alias("value"))


@query(
    "split_colon_underscore",
    f"WITH {S.NOISY} SELECT doc_id, replace(replace(text, ':', ' '), '_', ' ') AS value FROM noisy",
)
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.split_colon_underscore(F.col("text")).alias("value"))


@query(
    "strip_quotes",
    f"""WITH {S.NOISY} SELECT doc_id, replace(replace(text, '"', ''), '''', '') AS value FROM noisy""",
)
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.strip_quotes(F.col("text")).alias("value"))


@query("collapse_whitespace", f"WITH {S.NOISY} SELECT doc_id, {S.collapsed('text')} AS value FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.collapse_ws(F.col("text")).alias("value"))


@query("normalize_text", f"WITH {S.NOISY} SELECT doc_id, {S.normalized('text')} AS clean FROM noisy")
def _(spark, sf):
    return noisy(spark, sf).select("doc_id", N.normalize_text(F.col("text")).alias("clean"))


@query(
    "normalize_columns",
    f"""WITH {S.NOISY}, n AS (
      SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN text END AS text, upper(lang) AS lang FROM noisy)
    SELECT doc_id, {S.normalized("coalesce(text, '')")} AS text, {S.normalized("coalesce(lang, '')")} AS lang
    FROM n""",
)
def _(spark, sf):
    rows = noisy(spark, sf).select(
        "doc_id",
        F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"),
        F.upper("lang").alias("lang"),
    )
    return N.normalize_columns(rows, ["text", "lang", "absent"])


@query(
    "sql_functions",
    f"""WITH {S.NOISY} SELECT doc_id, {S.normalized('text')} AS clean,
      regexp_replace(text, '<.*?>', '', 'g') AS stripped, {S.without_urls('text')} AS unlinked,
      {S.contractions('text')} AS expanded, {S.chat_words('text')} AS spelled, {S.demojized('text')} AS named,
      {S.collapsed('text')} AS squeezed FROM noisy""",
)
def _(spark, sf):
    register_functions(spark)
    noisy(spark, sf).createOrReplaceTempView("noisy_documents")
    return spark.sql(
        """SELECT doc_id, normalize_text(text) AS clean, strip_html(text) AS stripped, strip_urls(text) AS unlinked,
          expand_contractions(text) AS expanded, expand_chat_words(text) AS spelled, demojize(text) AS named,
          collapse_ws(text) AS squeezed FROM noisy_documents"""
    )


@query(
    "sql_cosine",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score,
      0.0::DOUBLE AS nothing FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, sf):
    register_functions(spark)
    table(spark, sf, "embeddings").createOrReplaceTempView("vectors")
    return spark.sql(
        """SELECT a.vec_id, round(cosine(a.embedding, b.embedding), 9) AS score,
          cosine(a.embedding, transform(a.embedding, x -> 0F)) AS nothing
        FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1"""
    )


# --- tokens --------------------------------------------------------------


@query(
    "tokenize",
    f"WITH {S.tokens()} SELECT doc_id, tok_id, sent_id, text, lower, is_alpha, is_stop FROM toks",
)
def _(spark, sf):
    return O.token_rows(tokened(spark, sf), "doc_id")


@query(
    "alpha_flags",
    f"""WITH {S.tokens()}
    SELECT doc_id, sum(CAST(is_alpha AS INTEGER))::BIGINT AS alpha, count(*)::BIGINT AS tokens
    FROM toks GROUP BY 1""",
)
def _(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.explode(T.token_texts(F.col("text"))).alias("t"))
    return rows.groupBy("doc_id").agg(
        F.sum(T.is_alpha(F.col("t")).cast("int")).alias("alpha"), F.count("*").alias("tokens")
    )


@query(
    "stopword_join",
    f"""WITH {S.tokens()}
    SELECT lang, lower AS word, count(*)::BIGINT AS n FROM toks WHERE is_stop GROUP BY 1, 2""",
)
def _(spark, sf):
    lists = O.stop_lists(tuple(WORDS))
    words = spark.createDataFrame(
        [(lang, word) for lang, listed in lists.items() for word in listed], "lang string, word string"
    )
    rows = O.token_rows(tokened(spark, sf, words={"en": ["the"]}), "doc_id", "lang").drop("is_stop")
    flagged = O.flag_stopwords(rows, words).filter("is_stop")
    return flagged.groupBy("lang", F.col("lower").alias("word")).agg(F.count("*").alias("n"))


@query("pos_tags", f"WITH {S.annotated()} SELECT doc_id, tok_id, text, pos FROM ann")
def _(spark, sf):
    rows = O.tagged_rows(tokened(spark, sf), "doc_id")
    return rows.select("doc_id", "tok_id", "text", "pos")


@query(
    "pos_tags_by_lexicon",
    f"""WITH {S.annotated()}
    SELECT pos2 AS pos, count(*)::BIGINT AS n FROM (
      SELECT CASE lower WHEN 'th' THEN 'NOUN' WHEN 'er' THEN 'VERB' WHEN 'an' THEN 'DET' ELSE pos END AS pos2
      FROM ann) GROUP BY 1""",
)
def _(spark, sf):
    lexicon = spark.createDataFrame(
        [("th", "NOUN"), ("er", "VERB"), ("an", "DET")], "word string, pos string"
    )
    rows = O.token_rows(tokened(spark, sf), "doc_id")
    return O.tag_pos(rows, lexicon).groupBy("pos").agg(F.count("*").alias("n"))


def _joined(expr: str, sep: str, where: str, empty: str, source: str = "ann") -> str:
    return f"""SELECT d.doc_id, coalesce(s.v, {S.quoted(empty)}) AS value FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg({expr}, '{sep}' ORDER BY tok_id) AS v FROM {source}
      WHERE {where} GROUP BY 1) s USING (doc_id)"""


@query(
    "pos_string_text",
    f"WITH {S.annotated()} " + _joined("text || ' -> ' || pos", " , ", "is_alpha", "No POS tags found"),
)
def _(spark, sf):
    docs = tokened(spark, sf, annotate=True, fields=["pos"])
    return docs.select("doc_id", L.pos_string(toks(), "text").alias("value"))


@query(
    "pos_string_column",
    f"WITH {S.annotated()} " + _joined("text || ' -> ' || pos", " | ", "is_alpha", "No pos found"),
)
def _(spark, sf):
    docs = tokened(spark, sf, annotate=True, fields=["pos"])
    return docs.select("doc_id", L.pos_string(toks(), "column").alias("value"))


@query(
    "pos_string_from_token_table",
    f"WITH {S.annotated()} " + _joined("text || ' -> ' || pos", " , ", "is_alpha", "No POS tags found"),
)
def _(spark, sf):
    rows = O.tagged_rows(tokened(spark, sf), "doc_id")
    docs = O.assemble(rows.select("doc_id", "tok_id", "text", "pos", "is_alpha"), "doc_id", documents(spark, sf))
    return docs.select("doc_id", L.pos_string(toks(), "text").alias("value"))


@query(
    "pos_weightage",
    f"""WITH {S.annotated()}, c AS (
      SELECT doc_id, sum(CAST(is_alpha AS INTEGER)) AS words,
        count(*) FILTER (pos = 'PRON') AS pron, count(*) FILTER (pos = 'ADJ') AS adj,
        count(*) FILTER (pos = 'NOUN') AS noun, count(*) FILTER (pos = 'VERB') AS verb
      FROM ann GROUP BY 1)
    SELECT d.doc_id,
      CASE WHEN words > 0 THEN CAST(trunc(pron / words * 100) AS INTEGER) END AS pronoun,
      CASE WHEN words > 0 THEN CAST(trunc(adj / words * 100) AS INTEGER) END AS adjective,
      CASE WHEN words > 0 THEN CAST(trunc(noun / words * 100) AS INTEGER) END AS noun,
      CASE WHEN words > 0 THEN CAST(trunc(verb / words * 100) AS INTEGER) END AS verb
    FROM documents d LEFT JOIN c USING (doc_id)""",
)
def _(spark, sf):
    docs = tokened(spark, sf, annotate=True, fields=["pos"]).select("doc_id", L.pos_weightage(toks()).alias("w"))
    return docs.select(
        "doc_id", *(F.element_at("w", F.lit(name)).alias(name.lower()) for name in L.WEIGHTED_POS)
    )


@query(
    "dependency_text",
    f"WITH {S.parsed()}, linked AS (SELECT a.*, h.text AS head FROM dep a JOIN dep h"
    " ON a.doc_id = h.doc_id AND a.head_tok_id = h.tok_id) "
    + _joined("text || ' ->' || dep || ' -> ' || head", " , ", "is_alpha", "No dependnecy parsing found", "linked"),
)
def _(spark, sf):
    docs = tokened(spark, sf, heads=True, fields=["pos"])
    return docs.select("doc_id", L.dependency_string(toks(), "text").alias("value"))


@query(
    "dependency_column",
    f"WITH {S.parsed()}, linked AS (SELECT a.*, h.text AS head FROM dep a JOIN dep h"
    " ON a.doc_id = h.doc_id AND a.head_tok_id = h.tok_id) "
    + _joined(
        "text || ' ->' || pos || '->' || dep || ' -> ' || head", " | ", "is_alpha",
        "No dependency parsing found for given row", "linked",
    ),
)
def _(spark, sf):
    docs = tokened(spark, sf, heads=True, fields=["pos"])
    return docs.select("doc_id", L.dependency_string(toks(), "column").alias("value"))


# the commonest made-up words of the documents stand in for names
GAZETTEER = {"the": "DET", "of the": "GPE", "and the of": "ORG", "th": "PERSON", "de la": "GPE", "rewh orre": "ORG"}


def gazetteer(spark) -> DataFrame:
    return spark.createDataFrame(list(GAZETTEER.items()), "phrase string, label string")


ENTITIES = f"""{S.tokens()},
places(phrase, label) AS (VALUES {', '.join(f"('{p}', '{l}')" for p, l in GAZETTEER.items())}),
hits AS (
  SELECT doc_id, tok_id AS first, unnest([1, 2, 3, 4]) AS n,
    lower AS w1, text AS t1,
    lead(lower, 1) OVER d AS w2, lead(text, 1) OVER d AS t2,
    lead(lower, 2) OVER d AS w3, lead(text, 2) OVER d AS t3,
    lead(lower, 3) OVER d AS w4, lead(text, 3) OVER d AS t4
  FROM toks WINDOW d AS (PARTITION BY doc_id ORDER BY tok_id)),
grams AS (
  SELECT doc_id, first, n, first + n - 1 AS last,
    CASE n WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2 WHEN 3 THEN w1 || ' ' || w2 || ' ' || w3
      ELSE w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 END AS key,
    CASE n WHEN 1 THEN t1 WHEN 2 THEN t1 || ' ' || t2 WHEN 3 THEN t1 || ' ' || t2 || ' ' || t3
      ELSE t1 || ' ' || t2 || ' ' || t3 || ' ' || t4 END AS text
  FROM hits),
longest AS (
  SELECT g.doc_id, g.first, g.last, g.text, p.label,
    row_number() OVER (PARTITION BY g.doc_id ORDER BY g.first) AS rn
  FROM grams g JOIN places p ON g.key = p.phrase
  QUALIFY row_number() OVER (PARTITION BY g.doc_id, g.first ORDER BY g.n DESC) = 1),
numbered AS (SELECT doc_id, first, last, text, label,
    row_number() OVER (PARTITION BY doc_id ORDER BY first) AS rn FROM longest),
walk AS (
  SELECT doc_id, rn, first, last, text, label, true AS kept, last AS upto FROM numbered WHERE rn = 1
  UNION ALL
  SELECT x.doc_id, x.rn, x.first, x.last, x.text, x.label, x.first > w.upto,
    CASE WHEN x.first > w.upto THEN x.last ELSE w.upto END
  FROM walk w JOIN numbered x ON x.doc_id = w.doc_id AND x.rn = w.rn + 1),
ents AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS INTEGER) AS ent_id,
    text, label, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last
  FROM walk WHERE kept)"""


@query("entity_matches", f"WITH RECURSIVE {ENTITIES} SELECT * FROM ents")
def _(spark, sf):
    return O.match_entities(tokened(spark, sf), "doc_id", gazetteer(spark))


def _entity_sql(sep: str, empty: str) -> str:
    return f"""WITH RECURSIVE {ENTITIES}
    SELECT d.doc_id, coalesce(s.v, '{empty}') AS entities FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg(text || ' -> ' || label, '{sep}' ORDER BY ent_id) AS v
      FROM ents GROUP BY 1) s USING (doc_id)"""


def _entity_strings(spark, sf, mode):
    return O.text_entities(documents(spark, sf).select("doc_id", "text"), "text", gazetteer(spark), mode)


@query("entity_string_text", _entity_sql(" , ", "No entity relation found for given input"))
def _(spark, sf):
    return _entity_strings(spark, sf, "text")


@query("entity_string_column", _entity_sql(" | ", "No entity relation found for given row"))
def _(spark, sf):
    return _entity_strings(spark, sf, "column")


@query(
    "lemmatized_text",
    f"WITH {S.annotated()} " + _joined("lemma", " ", "is_alpha AND NOT is_stop", "None"),
)
def _(spark, sf):
    docs = tokened(spark, sf, annotate=True)
    return docs.select("doc_id", L.lemmatized_text(toks()).alias("value"))


@query(
    "morphology",
    f"WITH {S.annotated()} " + _joined("text || ' -> ' || morph", " , ", "is_alpha", "None"),
)
def _(spark, sf):
    docs = tokened(spark, sf, annotate=True)
    return docs.select("doc_id", L.morphology_string(toks()).alias("value"))


@query(
    "negations",
    f"""WITH {S.parsed()}
    SELECT doc_id, text || ' -> ' || head AS pair FROM (
      SELECT doc_id, text, dep, max(CASE WHEN tok_id = head_tok_id THEN text END) OVER (PARTITION BY doc_id, sent_id) AS head
      FROM dep) WHERE dep = 'neg'""",
)
def _(spark, sf):
    docs = tokened(spark, sf, heads=True, fields=["pos"])
    return docs.select("doc_id", F.explode_outer(L.negations(toks())).alias("pair")).filter(
        "pair is not null"
    )


@query(
    "lexical_negations",
    f"""WITH {S.tokens()}, w AS (
      SELECT doc_id, text, lower, lead(text) OVER (PARTITION BY doc_id ORDER BY tok_id) AS nxt
      FROM toks WHERE is_alpha)
    SELECT doc_id, text || ' -> ' || nxt AS pair FROM w
    WHERE lower IN ('not', 'no', 'pas', 'nicht', 'th') AND nxt IS NOT NULL""",
)
def _(spark, sf):
    pairs = L.lexical_negations(toks(), ("not", "no", "pas", "nicht", "th"))
    return tokened(spark, sf).select("doc_id", F.explode_outer(pairs).alias("pair")).filter(
        "pair is not null"
    )


RATIO = f"""SELECT d.doc_id, coalesce(k, 0)::BIGINT AS keywords, coalesce(s, 0)::BIGINT AS stopwords,
      {S.rounded('coalesce(k, 0) / (coalesce(s, 0) + 1)')} AS ratio
    FROM documents d LEFT JOIN (
      SELECT doc_id, count(*) FILTER (is_alpha AND NOT is_stop) AS k, count(*) FILTER (is_alpha AND is_stop) AS s
      FROM toks GROUP BY 1) c USING (doc_id)"""


@query("keyword_stopword_ratio", f"WITH {S.tokens()} {RATIO}")
def _(spark, sf):
    docs = tokened(spark, sf).select("doc_id", L.keyword_counts(toks()).alias("c"))
    return docs.select(
        "doc_id", F.col("c.keywords").cast("long").alias("keywords"),
        F.col("c.stopwords").cast("long").alias("stopwords"), "c.ratio",
    )


@query(
    "clean_text_ratio",
    f"""WITH {S.NOISY}, clean AS (SELECT doc_id, lang, {S.normalized('text')} AS text FROM noisy),
    {S.tokens('clean')} {RATIO}""",
)
def clean_text_ratio(spark, sf):
    """The flagship: normalise, tokenise, flag stop words, ratio per document."""
    clean = noisy(spark, sf).select("doc_id", "lang", N.normalize_text(F.col("text")).alias("text"))
    docs = O.with_tokens(clean, "text", "lang").select("doc_id", L.keyword_counts(toks()).alias("c"))
    return docs.select(
        "doc_id", F.col("c.keywords").cast("long").alias("keywords"),
        F.col("c.stopwords").cast("long").alias("stopwords"), "c.ratio",
    )


@query(
    "sentences",
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, {S.quoted(S.SENTENCE)}),
        lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '\\p{{L}}')) AS l FROM documents)
    SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS sent_no, unnest(l) AS sentence FROM s""",
)
def _(spark, sf):
    return O.split_sentences(documents(spark, sf), "doc_id", "text")


@query(
    "readability",
    f"""WITH {S.tokens()},
    w AS (SELECT doc_id, count(*) AS words, sum(length(text)) AS letters FROM toks WHERE is_alpha GROUP BY 1),
    b AS (SELECT d.doc_id, coalesce(words, 0) AS words, coalesce(letters, 0) AS letters,
        len(list_filter(regexp_extract_all(d.text, {S.quoted(S.SENTENCE)}), lambda x: regexp_matches(x, '\\p{{L}}'))) AS sents
      FROM documents d LEFT JOIN w USING (doc_id)),
    m AS (SELECT doc_id, CASE WHEN sents > 0 THEN words / sents ELSE 0.0 END AS a,
        CASE WHEN words > 0 THEN letters / words ELSE 0.0 END AS l FROM b)
    SELECT doc_id, {S.rounded('a::DOUBLE')} AS avg_sentence_length, {S.rounded('l::DOUBLE')} AS avg_word_length,
      {S.rounded('a * 0.6::DOUBLE + l * 0.4::DOUBLE')} AS complexity_score FROM m""",
)
def _(spark, sf):
    metrics = L.readability_metrics(F.col("text"), toks())
    return tokened(spark, sf).select("doc_id", metrics.alias("m")).select("doc_id", "m.*")


@query(
    "token_counts",
    f"""WITH {S.annotated()}
    SELECT doc_id, count(*) FILTER (is_alpha)::BIGINT AS words, count(*) FILTER (is_alpha AND is_stop)::BIGINT AS stopwords,
      coalesce(sum(length(text)) FILTER (is_alpha), 0)::BIGINT AS letters,
      count(*) FILTER (pos = 'PRON')::BIGINT AS Pronoun, count(*) FILTER (pos = 'ADJ')::BIGINT AS Adjective,
      count(*) FILTER (pos = 'NOUN')::BIGINT AS Noun, count(*) FILTER (pos = 'VERB')::BIGINT AS Verb
    FROM ann GROUP BY 1""",
)
def _(spark, sf):
    rows = O.tagged_rows(tokened(spark, sf), "doc_id")
    return O.summarize_tokens(rows, "doc_id").fillna(0, ["letters"])


# --- phrases -------------------------------------------------------------


@query("candidate_phrases", f"WITH {S.phrase_scores()} SELECT doc_id, phrase_idx, phrase FROM phrases")
def _(spark, sf):
    return K.candidate_phrases(tokened(spark, sf), "doc_id")


@query(
    "word_importance",
    f"""WITH {S.content_words()}
    SELECT doc_id, word, CAST(n AS INTEGER) AS n, round(n / max(n) OVER (PARTITION BY doc_id), 6) AS importance FROM freq""",
)
def _(spark, sf):
    found = K.word_importance(tokened(spark, sf), "doc_id")
    return found.withColumn("importance", F.round("importance", 6))


@query(
    "cooccurrence_edges",
    f"WITH {S.content_words()}, {S.EDGES} SELECT doc_id, src, dst FROM links",
)
def _(spark, sf):
    return K.cooccurrence_edges(worded(spark, sf), "doc_id")


@query(
    "pagerank",
    f"WITH RECURSIVE {S.content_words()}, {S.PAGERANK} SELECT doc_id, node, round(x, 6) AS score FROM ranked",
)
def _(spark, sf):
    return K.pagerank(worded(spark, sf), "doc_id").withColumn("score", F.round("score", 6))


COLUMN_SCORES = f"""{S.phrase_scores()}, scored AS (
  SELECT p.doc_id, p.phrase_idx, p.phrase, CAST(s.dot AS DOUBLE) / (s.norm * d.norm) AS similarity,
    CAST(s.dot AS DOUBLE) / d.top AS importance,
    0.7::DOUBLE * (CAST(s.dot AS DOUBLE) / (s.norm * d.norm)) + 0.3::DOUBLE * (CAST(s.dot AS DOUBLE) / d.top) AS score
  FROM phrases p JOIN sums s USING (doc_id, island) JOIN doc_norm d USING (doc_id))"""
TEXT_SCORES = f"""{S.phrase_scores()}, {S.PAGERANK},
best AS (SELECT doc_id, max(x) AS top FROM ranked GROUP BY 1),
weights AS (
  SELECT w.doc_id, w.island, sum(w.k * r.x) AS total FROM phrase_words w
  JOIN ranked r ON r.doc_id = w.doc_id AND r.node = w.word GROUP BY 1, 2),
scored AS (
  SELECT p.doc_id, p.phrase_idx, p.phrase, CAST(s.dot AS DOUBLE) / (s.norm * d.norm) AS similarity,
    t.total / b.top AS importance,
    0.7::DOUBLE * (CAST(s.dot AS DOUBLE) / (s.norm * d.norm)) + 0.3::DOUBLE * (t.total / b.top) AS score
  FROM phrases p JOIN sums s USING (doc_id, island) JOIN doc_norm d USING (doc_id)
  JOIN weights t USING (doc_id, island) JOIN best b USING (doc_id))"""


def _scores_sql(ctes: str) -> str:
    return f"""WITH RECURSIVE {ctes}
    SELECT doc_id, phrase_idx, phrase, round(similarity, 6) AS similarity,
      round(importance, 5) AS importance, round(score, 5) AS score FROM scored"""


def _keyphrase_sql(ctes: str, sep: str, empty: str) -> str:
    return f"""WITH RECURSIVE {ctes}
    SELECT d.doc_id, coalesce(s.v, '{empty}') AS key_phrase FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg(phrase, '{sep}' ORDER BY round(score, 9) DESC, phrase_idx) AS v
      FROM scored GROUP BY 1) s USING (doc_id)"""


def _scores(spark, sf, mode):
    found = K.hybrid_scores(tokened(spark, sf), "doc_id", mode)
    return found.select(
        "doc_id", "phrase_idx", "phrase", F.round("similarity", 6).alias("similarity"),
        F.round("importance", 5).alias("importance"), F.round("score", 5).alias("score"),
    )


@query("hybrid_scores_column", _scores_sql(COLUMN_SCORES))
def _(spark, sf):
    return _scores(spark, sf, "column")


@query("hybrid_scores_text", _scores_sql(TEXT_SCORES))
def _(spark, sf):
    return _scores(spark, sf, "text")


@query("keyphrases_column", _keyphrase_sql(COLUMN_SCORES, " | ", "No key phrase found for given row"))
def _(spark, sf):
    return K.keyphrases(tokened(spark, sf), "column").select("doc_id", "key_phrase")


@query("keyphrases_text", _keyphrase_sql(TEXT_SCORES, " , ", "None"))
def _(spark, sf):
    return K.keyphrases(tokened(spark, sf), "text").select("doc_id", "key_phrase")


@query(
    "top_keyphrases",
    f"""WITH {COLUMN_SCORES}
    SELECT doc_id, string_agg(phrase, ' | ' ORDER BY r) AS key_phrase FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase_idx) AS r FROM scored)
    WHERE r <= 3 GROUP BY 1""",
)
def _(spark, sf):
    scored = K.hybrid_scores(tokened(spark, sf), "doc_id", "column")
    return K.rank_phrases(scored, "doc_id", "column", k=3)


@query(
    "embedding",
    f"""WITH {S.content_words()},
    slotted AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS slot, sum(n) AS n FROM freq GROUP BY 1, 2),
    seen AS (SELECT slot, count(*) AS df FROM slotted GROUP BY 1),
    weighted AS (SELECT doc_id, slot, n * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) AS x FROM slotted JOIN seen USING (slot)),
    norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM weighted GROUP BY 1),
    cells AS (SELECT doc_id, slot, round((coalesce(CASE WHEN norm > 0 THEN x / norm END, 0)::FLOAT)::DOUBLE, 4) AS x
      FROM documents CROSS JOIN (SELECT unnest(range(64)) AS slot) LEFT JOIN weighted USING (doc_id, slot) LEFT JOIN norms USING (doc_id))
    SELECT doc_id, list(x ORDER BY slot) AS embedding FROM cells GROUP BY 1""",
)
def _(spark, sf):
    docs = K.embed(tokened(spark, sf), dims=64, keep=["doc_id"])
    return docs.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@query(
    "cosine_to_label_mean",
    """WITH parts AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT label, list(m ORDER BY i) AS centre FROM (
      SELECT label, i, avg(v::DOUBLE) AS m FROM parts GROUP BY 1, 2) GROUP BY 1)
    SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], m.centre), 4) AS similarity
    FROM embeddings e JOIN means m USING (label)""",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre")
    )
    joined = K.similarity_join(vectors, centres, ["label"], "embedding", "centre")
    return joined.select("vec_id", F.round("similarity", 4).alias("similarity"))


# --- enrichment ----------------------------------------------------------


def _after(ctes: str) -> str:
    """CTEs without the token steps, for use behind others that have them already."""
    name = f"unused_{len(ctes)}"
    return ctes.replace(S.tokens(), f"{name} AS (SELECT 1)", 1)


CLEAN = f"{S.NOISY}, clean AS (SELECT doc_id, lang, {S.normalized('text')} AS text FROM noisy)"
LINKED = """linked AS (SELECT a.*, h.text AS head FROM dep a JOIN dep h ON a.doc_id = h.doc_id AND a.head_tok_id = h.tok_id)"""


@query(
    "analyze_text",
    f"""WITH RECURSIVE {CLEAN}, {S.parsed('clean')}, {LINKED},
    agg AS (
      SELECT doc_id,
        string_agg(lemma, ' ' ORDER BY tok_id) FILTER (is_alpha AND NOT is_stop) AS lemmatized,
        string_agg(text || ' -> ' || pos, ' , ' ORDER BY tok_id) FILTER (is_alpha) AS pos,
        string_agg(text || ' ->' || dep || ' -> ' || head, ' , ' ORDER BY tok_id) FILTER (is_alpha) AS dependency,
        string_agg(text || ' -> ' || morph, ' , ' ORDER BY tok_id) FILTER (is_alpha) AS morphology,
        string_agg(text || ' -> ' || head, ' | ' ORDER BY tok_id) FILTER (dep = 'neg') AS negation,
        count(*) FILTER (is_alpha) AS words, sum(length(text)) FILTER (is_alpha) AS letters,
        count(*) FILTER (pos = 'NOUN') AS noun, count(*) FILTER (pos = 'VERB') AS verb,
        count(*) FILTER (is_alpha AND NOT is_stop) AS k, count(*) FILTER (is_alpha AND is_stop) AS s
      FROM linked GROUP BY 1),
    lengths AS (SELECT c.doc_id, coalesce(words, 0) AS words, coalesce(letters, 0) AS letters,
        len(list_filter(regexp_extract_all(c.text, {S.quoted(S.SENTENCE)}), lambda x: regexp_matches(x, '\\p{{L}}'))) AS sents
      FROM clean c LEFT JOIN agg USING (doc_id)),
    read AS (SELECT doc_id, CASE WHEN sents > 0 THEN words / sents ELSE 0.0 END AS a,
        CASE WHEN words > 0 THEN letters / words ELSE 0.0 END AS l FROM lengths),
    {_after(ENTITIES)},
    names AS (SELECT doc_id, string_agg(text || ' -> ' || label, ' , ' ORDER BY ent_id) AS v FROM ents GROUP BY 1),
    {_after(TEXT_SCORES)},
    ranked_phrases AS (
      SELECT doc_id, string_agg(phrase, ' , ' ORDER BY round(score, 9) DESC, phrase_idx) AS v FROM scored GROUP BY 1)
    SELECT c.doc_id, c.text AS clean, coalesce(lemmatized, 'None') AS lemmatized,
      coalesce(pos, 'No POS tags found') AS pos, coalesce(dependency, 'No dependnecy parsing found') AS dependency,
      coalesce(morphology, 'None') AS morphology, coalesce(negation, '') AS negation,
      CASE WHEN words > 0 THEN CAST(trunc(noun / words * 100) AS INTEGER) END AS nouns,
      CASE WHEN words > 0 THEN CAST(trunc(verb / words * 100) AS INTEGER) END AS verbs,
      'keywords -> ' || coalesce(k, 0) || ' , stopwords -> ' || coalesce(s, 0) || ' , ratio -> '
        || CAST({S.rounded('coalesce(k, 0) / (coalesce(s, 0) + 1)')} AS VARCHAR) AS keyword_stopword_ratio,
      'avg_sentence_length -> ' || CAST({S.rounded('a::DOUBLE')} AS VARCHAR) || ' , avg_word_length -> '
        || CAST({S.rounded('l::DOUBLE')} AS VARCHAR) || ' , complexity_score -> '
        || CAST({S.rounded('a * 0.6::DOUBLE + l * 0.4::DOUBLE')} AS VARCHAR) AS readability,
      coalesce(names.v, 'No entity relation found for given input') AS entities, coalesce(r.v, 'None') AS keyphrases
    FROM clean c LEFT JOIN agg USING (doc_id) LEFT JOIN read USING (doc_id) LEFT JOIN names USING (doc_id)
    LEFT JOIN ranked_phrases r USING (doc_id)""",
)
def _(spark, sf):
    found = E.analyze_text(noisy(spark, sf), "doc_id", "text", "lang", gazetteer(spark))
    weights = F.col("result.linguistics.POS_weightage")
    return found.select(
        "doc_id", "result.text.clean", "result.text.lemmatized", "result.linguistics.pos",
        "result.linguistics.dependency", "result.linguistics.morphology",
        F.array_join("result.linguistics.negation", " | ").alias("negation"),
        F.element_at(weights, F.lit("Noun")).alias("nouns"), F.element_at(weights, F.lit("Verb")).alias("verbs"),
        "result.metrics.keyword_stopword_ratio", "result.metrics.readability", "result.entities", "result.keyphrases",
    )


@query("analyze_text_json")
def _(spark, sf):
    found = E.analyze_text(noisy(spark, sf), "doc_id", "text", "lang", gazetteer(spark))
    return found.select("doc_id", F.to_json("result").alias("result"))


def enriched_sql(clean: str, more: str, entities: bool) -> str:
    """The column mode's four results for a CTE ``clean`` of (doc_id, lang, text)."""
    names = f"""{_after(ENTITIES)},
    names AS (SELECT doc_id, string_agg(text || ' -> ' || label, ' | ' ORDER BY ent_id) AS v FROM ents GROUP BY 1),"""
    return f"""WITH RECURSIVE {clean}, {S.parsed('clean')}, {LINKED},
    agg AS (
      SELECT doc_id,
        string_agg(text || ' -> ' || pos, ' | ' ORDER BY tok_id) FILTER (is_alpha) AS pos,
        string_agg(text || ' ->' || pos || '->' || dep || ' -> ' || head, ' | ' ORDER BY tok_id) FILTER (is_alpha) AS dependency
      FROM linked GROUP BY 1),
    {names if entities else "names AS (SELECT doc_id, NULL::VARCHAR AS v FROM clean),"}
    {_after(COLUMN_SCORES)},
    ranked_phrases AS (
      SELECT doc_id, string_agg(phrase, ' | ' ORDER BY round(score, 9) DESC, phrase_idx) AS v FROM scored GROUP BY 1)
    SELECT {more} c.text, coalesce(pos, 'No pos found') AS text__pos,
      coalesce(dependency, 'No dependency parsing found for given row') AS text__dependency,
      coalesce(names.v, 'No entity relation found for given row') AS text__ner,
      coalesce(r.v, 'No key phrase found for given row') AS text__key_phrase
    FROM clean c LEFT JOIN agg USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN ranked_phrases r USING (doc_id)"""


@query("enrich_columns", enriched_sql(CLEAN, "c.doc_id, c.lang, 'Processing failed' AS absent__error,", False))
def _(spark, sf):
    return E.enrich(noisy(spark, sf), ["text", "absent"], "doc_id", lang="lang")


@query("enrich_columns_with_entities", enriched_sql(CLEAN, "c.doc_id, c.lang,", True))
def _(spark, sf):
    rows = noisy(spark, sf)
    return E.enrich(rows, ["text"], "doc_id", lang="lang", gazetteer=gazetteer(spark))


@query(
    "distinct_then_join",
    f"WITH {S.NOISY}, n AS (SELECT doc_id, {S.normalized('text')} AS clean FROM documents) SELECT * FROM n",
)
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    found = E.dedup_apply(
        docs, "text", "doc_id", lambda t: t.withColumn("clean", N.normalize_text(F.col("text")))
    )
    return found.select("doc_id", "clean")


# --- hooks ---------------------------------------------------------------


VOWELS = "length(regexp_replace(text, '[^aeiou]', '', 'g'))"


@query("annotator_hook", f"SELECT doc_id, CAST({VOWELS} AS BIGINT) AS vowels FROM documents")
def _(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    return H.annotate_with(docs, toys.model, toys.annotate, "doc_id long, vowels long")


@query(
    "row_error_isolation",
    f"SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN CAST({VOWELS} AS BIGINT) END AS vowels FROM documents",
)
def _(spark, sf):
    return H.safe_apply(documents(spark, sf), toys.model, toys.row, "doc_id", "text", {"vowels": "long"})


@query(
    "embedder_hook",
    """SELECT doc_id, concat_ws(',', length(text) - length(replace(text, 'a', '')),
      length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'i', '')),
      length(text) - length(replace(text, 'o', '')), length(text) - length(replace(text, 'u', ''))) AS vector
    FROM documents""",
)
def _(spark, sf):
    embed = H.embed_with(toys.model, toys.embed)
    docs = documents(spark, sf).select("doc_id", "text")
    found = E.dedup_apply(docs, "text", "doc_id", lambda t: t.withColumn("v", embed(F.col("text"))))
    return found.select(
        "doc_id", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("vector")
    )
