"""Fill-in-middle: cut a text into prefix, middle and suffix, and write them in another order.

Cuts are drawn in tokens (a run of A-Z and a-z, or any other single character). A
text is worked on as bytes. Where characters and bytes differ is kept as a sparse
list of exceptions, one entry per multibyte character: its place and the excess
bytes so far. A cut moves between characters and bytes by one search in that
list, and by plain arithmetic where the text is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.llm.common import hex_number

#: Signs before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Shares of 100: texts that stay plain, and among the others those that open with the suffix.
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20
#: Bytes whose tokens are looked at together.
STRETCH = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Exceptions:
    """The multibyte characters of a text: places in bytes and in characters, excess bytes up to and with each."""

    at_byte: np.ndarray
    at_char: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, text: bytes) -> Exceptions:
        if text.isascii():
            none = np.zeros(0, np.int64)
            return cls(none, none, none)
        data = np.frombuffer(text, np.uint8)
        at = np.flatnonzero(data >= 0xC0)
        lead = data[at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.cumsum(extra)
        return cls(at, at - (excess - extra), excess)

    def chars(self, cut: int) -> int:
        """Characters before a byte cut."""
        k = int(np.searchsorted(self.at_byte, cut))
        return cut - (int(self.excess[k - 1]) if k else 0)

    def bytes(self, cut: int) -> int:
        """Bytes before a character cut."""
        k = int(np.searchsorted(self.at_char, cut))
        return cut + (int(self.excess[k - 1]) if k else 0)


def _opens(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which bytes from low to high begin a token."""
    part = data[low:high]
    letter = _LETTER[part]
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[0] = low > 0 and _LETTER[data[low - 1]]
    return ((part & 0xC0) != 0x80) & ~(letter & before)


def token_counts(text: bytes) -> np.ndarray:
    """Running number of tokens that begin in each stretch of the text."""
    data = np.frombuffer(text, np.uint8)
    return np.cumsum([_opens(data, a, a + STRETCH).sum() for a in range(0, len(data), STRETCH)], dtype=np.int64)


def token_place(text: bytes, counts: np.ndarray, token: int) -> int:
    """Byte at which a token begins; the text's length for the one after the last."""
    k = int(np.searchsorted(counts, token, "right"))
    if k == len(counts):
        return len(text)
    low = k * STRETCH
    here = np.flatnonzero(_opens(np.frombuffer(text, np.uint8), low, low + STRETCH))
    return low + int(here[token - (counts[k - 1] if k else 0)])


def cut_text(text: bytes, draws: tuple[int, int, int, int], signs: tuple[bytes, bytes, bytes]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text with its four random numbers."""
    counts = token_counts(text)
    n = int(counts[-1]) if len(counts) else 0
    if not n or any(s in text for s in signs) or draws[2] % 100 >= 100 - PLAIN_SHARE:
        return n, "plain", None, None, text
    first, last = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = token_place(text, counts, first), token_place(text, counts, last)
    index = Exceptions.of(text)
    before, inner = index.chars(a), index.chars(b)
    before_sign, after_sign, middle_sign = signs
    prefix, middle, suffix = before_sign + text[:a], middle_sign + text[a:b], after_sign + text[b:]
    if draws[3] % 100 < SUFFIX_FIRST_SHARE:
        return n, "spm", before, inner - before, suffix + prefix + middle
    return n, "psm", before, inner - before, prefix + suffix + middle


def draws_of(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four 32-bit numbers that seed and id decide; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [hex_number(digest, 1 + 8 * k, 8) for k in range(4)]


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """Every document's fill-in-middle form: doc_id, n, form, prefix_chars, middle_chars, output.

    ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain: empty
    texts, texts that hold one of the signs, and a share of all others. A null text is
    an empty one. Id and seed alone decide, so repeated rows and reruns agree; a null id
    counts as an empty one. Texts are whole, tokens are looked at a stretch at a time.
    Only the two named columns are read. An empty table gives an empty result.
    """
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"),
        *(d.alias(f"d{k}") for k, d in enumerate(draws_of(docs[id_col], seed))),
    )
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]
    schema = T.StructType([id_field, *(T.StructField(*f) for f in fields), T.StructField("output", T.BinaryType())])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    signs = (PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = zip(*(batch.column(2 + k).to_pylist() for k in range(4)))
            done = [cut_text(text.as_py(), d, signs) for text, d in zip(batch.column(1), draws)]
            columns = [pa.array([r[k] for r in done], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Neither part holds a sign, so the signs cut it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, third, second))
        .when(form == "spm", F.concat(second, third, first))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """``transformed`` with digests in place of texts, and the digest of the text rebuilt from each output."""
    done = transformed(docs, id_col, text_col, seed)
    back = restored(F.col("output"), F.col("form"))
    return done.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )
