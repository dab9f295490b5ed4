"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

# Inside a Java character class: every character Python's str.split() and
# str.strip() treat as whitespace. Java's \s alone covers only the ASCII ones.
RARE_WS = r"\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# a wider class that tests faster
MAYBE_RARE_WS = r"[\x1c\x1d\x1e\x1f\x85\xa0\u1680-\u3000]"
WS = r"\s" + RARE_WS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def is_one_of(c: Column, words: Iterable[str]) -> Column:
    """``isin`` for long word lists: the list reaches the JVM in one call, not one per word.

    Spark turns the test into a hash set.
    """
    listed = sorted(set(words))
    jvm = SparkContext._active_spark_context._jvm
    tokens = jvm.java.util.StringTokenizer("\n".join(listed), "\n")
    test = Column(c._jc.isInCollection(jvm.java.util.Collections.list(tokens)))
    return test | (c == "") if "" in listed else test


def const_map(pairs: Mapping[str, str]) -> Column:
    """A constant string map as one literal (folded at planning time)."""
    text = "\n".join(f"{key}\t{value}" for key, value in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\n"), F.lit("\t"))


def replace_words(word: Column, key: Column, table: Mapping[str, str]) -> Column:
    """``table[key]`` where present, else ``word``.

    The set test is a hash probe; only hits pay for the map's linear search.
    """
    return F.when(is_one_of(key, table), F.element_at(const_map(table), key)).otherwise(word)


def is_blank(c: Column) -> Column:
    """Null, empty, or only whitespace."""
    return c.isNull() | ~c.rlike(f"[^{WS}]")


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(c, f"[{WS}]+"), lambda w: w != ""))


def round_binary(c: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even, as Python's ``round`` does.

    Spark's ``round`` works on the shortest decimal text instead (2.175 becomes 2.18).
    """
    return F.translate(F.format_number(c, digits), ",", "").cast("double")


def unnest(df: DataFrame, keep: Sequence[str], structs: Column, field: str) -> DataFrame:
    """One row per struct of an array column, next to the ``keep`` columns.

    The plain ``inline`` makes the optimizer add a test for empty arrays below
    it, which computes the array a second time; the outer form does not. Its row
    for an empty array is told by a null ``field``, which no struct may have.
    """
    return df.select(*keep, F.inline_outer(structs)).filter(F.col(field).isNotNull())
