"""Registered queries of the corpus operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lexiframe.llm import classlm, decontaminate, exactdedup, fillmiddle, htmltext, licenses, linededup, mixing, neardup, quality
from lexiframe.llm import pieces, resample, sharding
from lexiframe.session import apply_settings, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(apply_settings(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix_sql(documents: str = "documents") -> str:
    """The same mix by windows over whole sources."""
    fills = "".join(
        f""",
    f{k} AS (SELECT * EXCLUDE (gap, run, took), gap - coalesce(sum(size) FILTER (took) OVER (PARTITION BY source), 0) AS gap,
      done OR took AS done1 FROM p{k}),
    g{k} AS (SELECT * EXCLUDE (done, done1), done1 AS done FROM f{k}),
    r{k + 1} AS (SELECT *, sum(size) FILTER (place IS NOT NULL AND NOT done AND size <= gap)
      OVER (PARTITION BY source ORDER BY place, doc_id) AS run FROM g{k}),
    p{k + 1} AS (SELECT *, coalesce(place IS NOT NULL AND NOT done AND size <= gap AND run <= gap, false) AS took FROM r{k + 1})"""
        for k in range(mixing.FILLS)
    )
    return f"""WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {documents}),
    per AS (SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
    w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
      2 * source_size AS cap FROM per),
    o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (
        ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
      sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
    l AS (SELECT *, cap / weight <= remains / weights AS filled, remains / weights AS level FROM o),
    t AS (SELECT source, n, source_size, CASE WHEN filled THEN cap::DOUBLE
      ELSE max(CASE WHEN NOT filled THEN level END) OVER () * weight END AS target FROM l),
    r AS (SELECT doc_id, sized.source, size, source_size, target, target / source_size AS rate, source_size / n AS mean,
      (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
    c AS (SELECT *, coalesce(floor(rate), 0)::BIGINT AS copies, coalesce(rate - floor(rate), 0) AS rest FROM r),
    q AS (SELECT *, rest + least(rest, 1 - rest) * 0.5::DOUBLE * (size - mean) / (size + mean) AS chance FROM c),
    d AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS odds FROM q),
    e AS (SELECT doc_id, source, size, source_size, target, copies, CASE WHEN rest > 0 THEN odds / (1 + odds) END AS place,
      target - copies * source_size AS gap, false AS done FROM d),
    r0 AS (SELECT *, sum(size) FILTER (place IS NOT NULL) OVER (PARTITION BY source ORDER BY place, doc_id) AS run FROM e),
    p0 AS (SELECT *, coalesce(place IS NOT NULL AND run <= gap, false) AS took FROM r0){fills}
    SELECT doc_id, size, source_size, target, ((copies + (done OR took)::INTEGER) * size)::BIGINT AS taken, source,
      (copies + (done OR took)::INTEGER)::INTEGER AS copies FROM p{mixing.FILLS}"""


WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@query(
    "op1_positional_decontamination",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM benchmark),
    bi AS (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
    ks AS (SELECT DISTINCT k FROM bw),
    di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
    dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
    hit AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, g)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
    s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)""",
)
def _(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_mix_sources", mix_sql())
def _(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query("op3_similar_lines")
def _(spark, sf):
    return linededup.repeated_lines(table(spark, sf, "documents"))


@query("op4_block_labeller")
def _(spark, sf):
    return htmltext.extract(table(spark, sf, "pages"))


@query("op5_virtual_slots")
def _(spark, sf):
    return sharding.shard_documents(table(spark, sf, "documents"), scratch_path(spark, "slot-map"))


@query("op6_byte_cnn_quality")
def _(spark, sf):
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_probminhash_neardup")
def _(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"))


def licence_sql() -> str:
    """The same canonical forms and look-ups; known texts as a list of values."""

    def canonical(text: str) -> str:
        out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(?m){licenses.COPYRIGHT_LINE}', '', 'g')"
        out = f"regexp_replace({out}, '{licenses.MARKS}', ' ', 'g')"
        for found, put in licenses.SPELLINGS:
            out = f"regexp_replace({out}, '{found}', '{put}', 'g')"
        return f"trim({out})"

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, each in licenses.known_texts().items() for t in each)
    return f"""WITH k AS (SELECT sha256(form) AS digest, min(licence) AS licence FROM (
      SELECT licence, {canonical('t')} AS form FROM (VALUES {known}) AS v(licence, t)) WHERE form <> '' GROUP BY 1),
    whole AS (SELECT doc_id, {canonical("coalesce(text, '')")} AS form FROM documents),
    parts AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part FROM documents),
    hits AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
      FROM (SELECT doc_id, {canonical('part')} AS form FROM parts) JOIN k ON digest = sha256(form) WHERE form <> '' GROUP BY 1)
    SELECT doc_id, licence, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(notices, '') AS notices
    FROM whole LEFT JOIN k ON form <> '' AND digest = sha256(form) LEFT JOIN hits USING (doc_id)"""


@query("op8_licence_digests", licence_sql())
def _(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query(
    "op9_bloom_exact_dedup",
    f"""WITH h AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)""",
)
def _(spark, sf):
    return exactdedup.exact_copies(table(spark, sf, "documents"))


@query("op10_class_bigrams")
def _(spark, sf):
    return classlm.score_texts(table(spark, sf, "documents"))


def resample_sql() -> str:
    """The same weights and ranks; the crc32 of each distinct word is folded byte by byte."""
    bits = "4294967295"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    sizes = f"{resample.BUCKETS}"
    ratio = f"((t + 1.0::DOUBLE) * (all_s + {sizes}.0::DOUBLE)) / ((s + 1.0::DOUBLE) * (all_t + {sizes}.0::DOUBLE))"
    hash_of = f"('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT"
    return f"""WITH RECURSIVE fold(i, k, c) AS (
      SELECT i, 0, i FROM (SELECT unnest(range(256))::BIGINT AS i) UNION ALL SELECT i, k + 1, {step} FROM fold WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS cells FROM fold WHERE k = 8),
    d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
    b AS (SELECT regexp_extract_all({LOWERED}, '{WORD}') AS w FROM benchmark),
    dw AS (SELECT doc_id, unnest(w) AS word FROM d),
    bw AS (SELECT unnest(w) AS word FROM b),
    distinct_words AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
    hashed AS (SELECT word, xor(list_reduce(
        list_prepend({bits}::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, y: xor(c >> 8, cells[(xor(c, y) & 255) + 1])), {bits}::BIGINT) % {sizes} AS bucket FROM distinct_words, crc),
    ns AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY 1),
    nt AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (word) GROUP BY 1),
    g AS (SELECT bucket, floor(1000 * ln({ratio}))::BIGINT AS gain FROM (
      SELECT bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t, (SELECT coalesce(sum(s), 0) FROM ns)::DOUBLE AS all_s,
        (SELECT coalesce(sum(t), 0) FROM nt)::DOUBLE AS all_t FROM ns FULL JOIN nt USING (bucket))),
    w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
      FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY 1),
    z AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
      coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(({hash_of} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN w USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {resample.FEWEST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place,
      count(*) FILTER (n_features >= {resample.FEWEST_WORDS}) OVER () * {resample.SHARE} // 100 AS need FROM z)
    SELECT doc_id, n_features, weight, score,
      CASE WHEN n_features >= {resample.FEWEST_WORDS} AND place <= need THEN place END AS rank FROM r"""


@query("op11_importance_resampling", resample_sql())
def _(spark, sf):
    return resample.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_sentence_pieces")
def _(spark, sf):
    return pieces.piece_digests(table(spark, sf, "documents"), pieces.public_model())


def fill_middle_sql() -> str:
    """The same cuts by lists of tokens."""
    p, s, m = fillmiddle.PREFIX, fillmiddle.SUFFIX, fillmiddle.MIDDLE
    number = lambda k: f"('0x' || substr(x, {1 + 8 * k}, 8))::BIGINT"
    plain = f"n = 0 OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fillmiddle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS x,
      regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, len(w)::BIGINT AS n FROM documents),
    c AS (SELECT *, least({number(0)} % (n + 1), {number(1)} % (n + 1)) AS a, greatest({number(0)} % (n + 1), {number(1)} % (n + 1)) AS b,
      CASE WHEN {plain} OR {number(2)} % 100 >= {100 - fillmiddle.PLAIN_SHARE} THEN 'plain'
        WHEN {number(3)} % 100 < {fillmiddle.SUFFIX_FIRST_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM d),
    e AS (SELECT doc_id, n, form, t, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid,
      array_to_string(w[b + 1:n], '') AS post FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || post || '{m}' || mid
        ELSE '{s}' || post || '{p}' || pre || '{m}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM e"""


@query("op13_fill_in_middle", fill_middle_sql())
def _(spark, sf):
    return fillmiddle.fill_in_middle(table(spark, sf, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
