"""Licence scan by canonical digests.

A text is brought into a canonical form in which spelling, case, punctuation and
copyright lines no longer matter, and its digest is looked up among the digests of
known licences by a hash join. Documents are looked up whole, and so is each of
their lines, since short notices stand on a line of their own.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.llm.common import lower_az, stored
from lexiframe.llm.licensetexts import known_texts

#: Lines that name who holds a copyright and since when say nothing about the licence.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(?:copyright\s*(?:\(c\)|©|&copy;|[0-9]{4}|by )|\(c\) ?[0-9]{4}|© ?[0-9a-z]|all rights reserved)[^\n]*"
_LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
MARKS = r"[^\p{L}\p{N}]+"
#: Spellings that count as the same, applied to lower-case words between single spaces, in this order.
SPELLINGS = (
    (r"licenc", "licens"),
    (r"\b(acknowledg|judg|fulfil)e?l?ment", r"\1ment"),
    (r"\b(fav|hon|behavi|lab)our", r"\1or"),
    (r"(organ|author|recogn|util|initial)is", r"\1iz"),
    (r"\b(sub|non) ", r"\1"),
    (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"),
    (r"\bcopyright (holder|owner|author)", "copyright holder"),
    (r"\bhttps\b", "http"),
    (r"\bv(ersion)? ?([0-9])", r"version \2"),
)


def canonical(text: Column) -> Column:
    """The canonical form; licences that differ only in what does not matter have the same one."""
    without = F.regexp_replace(lower_az(text), "(?md)" + COPYRIGHT_LINE, "")
    words = F.regexp_replace(without, MARKS, " ")
    # most texts hold none of the spellings: each is replaced only where it is found
    return F.trim(reduce(lambda t, s: F.regexp_replace(t, s[0], s[1].replace("\\", "$")), SPELLINGS, words))


def digest(text: Column) -> Column:
    """The digest of the canonical form; nothing for a text without words."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def _stable(word: str) -> str | None:
    """What every spelling of a word holds, or nothing if that is not known: no rule may change or produce the word."""
    if "licens" in word or "licenc" in word:
        return "licen"
    touched = ("ment", "or", "iz", "sub", "non", "while", "percent", "copyright", "holder", "owner", "http", "version")
    changed = any(re.search(pattern, word) for pattern, _ in SPELLINGS)
    return None if len(word) < 6 or changed or any(t in word for t in touched) else word


def anchors(texts: Mapping[str, list[str]]) -> list[str]:
    """A few pieces of words such that every known text holds one of them, however it is spelled.

    A text without any of them is no known text and needs no canonical form.
    """
    low = (t.translate(_LOWER) for each in texts.values() for t in each)
    bare = (re.sub(COPYRIGHT_LINE, "", t, flags=re.M | re.A) for t in low)
    marks = [{a for w in re.findall(r"[^\W_]+", t) if (a := _stable(w))} for t in bare]
    if not all(marks):
        return [""]  # some text has no such word: every text is a candidate
    chosen, left = [], marks
    while left:
        best = max(sorted({m for each in left for m in each}), key=lambda m: sum(m in each for each in left))
        chosen.append(best)
        left = [each for each in left if best not in each]
    return chosen


def known_digests(spark: SparkSession, texts: Mapping[str, list[str]]) -> DataFrame:
    """(licence, digest): one row per known text. Its size is that of the list given."""
    pairs = [(name, t) for name, each in texts.items() for t in each]
    rows = F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, t in pairs))
    listed = spark.range(1).select(F.explode(rows).alias("x"))
    digests = listed.select("x.licence", digest(F.col("x.text")).alias("digest"))
    return digests.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: Mapping[str, list[str]] | None = None,
) -> DataFrame:
    """One row per document: the licence that its whole text is, and the notices among its lines.

    Null, empty and wordless texts have no licence. A line counts as a notice when the
    whole line is a known text. Repeated rows are judged alike. If texts of several
    licences have one canonical form, the first name counts; known texts without words
    match nothing. Only the two named columns are read. An empty table gives an empty
    result.

    Columns: doc_id, licence, n_notices, notices (names, comma-joined).
    """
    texts = {name: [t for t in each if re.search(r"[^\W_]", t)] for name, each in (texts or known_texts()).items()}
    marks = anchors(texts)

    def candidate(text: Column) -> Column:
        low = lower_az(text)
        return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in marks), F.lit(False))

    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n"), candidate), digest)
    some = docs.select(
        docs[id_col].alias("doc_id"),
        F.when(candidate(text), F.struct(digest(text).alias("digest"), lines.alias("lines"))).alias("found"),
    )
    table = stored(some.withColumn("row", F.monotonically_increasing_id()), "canonical-digests")
    known = stored(known_digests(docs.sparkSession, texts), "known-licences")

    # the known list is bounded: joined where the lines are, only hits go on
    hits = table.select("row", F.explode("found.lines").alias("digest")).join(F.broadcast(known), "digest").groupBy("row").agg(
        F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices")
    )
    whole = table.select("row", "doc_id", F.col("found.digest").alias("digest")).join(F.broadcast(known), "digest", "left")
    return whole.join(hits, "row", "left").select(
        "doc_id", "licence",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"),
    )
