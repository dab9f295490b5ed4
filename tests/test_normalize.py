from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiframe.functions import lexicons
from lexiframe.functions import normalize as N
from lexiframe.functions.columns import round_binary

GOLDEN = [
    ("  Hello <b>World</b>  visit https://x.io/a?b NOW  ", "hello world visit now"),
    ("BTW lol, idk", "By The Way lol, I Dont Know"),
    ("Meet at 10:30 in room_5", "meet at 10 30 in room 5"),
    ("a < b and c > d", "a d"),
    ('I don\'t know \U0001f600 "quoted"', "i do not know grinning face quoted"),
    ("TGIF www.site.com/x <i>ok</i>", "Thank God Its Friday ok"),
    ("line1\nline2\tend", "line1 line2 end"),
    ("<a\nb> kept", "<a b> kept"),
    ("", ""),
]


def apply(spark, fn, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in rows.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_golden(spark):
    texts, want = zip(*GOLDEN)
    assert apply(spark, N.normalize_text, texts) == list(want)


def test_null_stays_null_in_text_mode_and_empties_in_column_mode(spark):
    rows = spark.createDataFrame([(1, None)], "i int, t string")
    assert rows.select(N.normalize_text(F.col("t"))).first()[0] is None
    assert N.normalize_columns(rows, ["t", "absent"]).first().t == ""


@pytest.mark.parametrize("space", ["\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", "\x0b"])
def test_every_python_space_counts(spark, space):
    assert apply(spark, N.collapse_ws, [f"{space}a{space}{space}b{space}"]) == ["a b"]


def test_contractions_need_whole_words(spark):
    texts = ["can't, don’t; isn't!", "xdon't don'ts", "it's o'clock"]
    assert apply(spark, N.expand_contractions, texts) == [
        "cannot, do not; is not!", "xdon't don'ts", "it is of the clock",
    ]


def test_emoji_names_come_from_unicode(spark):
    texts = ["\U0001f44d\U0001f3fd ok", "a❤️b", "plain ☃ ✓", "⭐⌚⏰‼", "\U0001f1eb\U0001f1f7 \U0001f7e0", "„a“ – €"]
    assert apply(spark, N.demojize, texts) == [
        ":thumbs_up::medium_skin_tone: ok", "a:red_heart:b", "plain :snowman: ✓",
        ":white_medium_star::watch::alarm_clock::double_exclamation_mark:",
        ":regional_indicator_symbol_letter_f::regional_indicator_symbol_letter_r: :large_orange_circle:", "„a“ – €",
    ]


def slow_normalize(text):
    """The chain step by step in plain Python."""
    text = re.sub(r"<.*?>", "", text.strip().lower())
    text = re.sub(r"https?://\S+|www\.\S+", "", text)
    words = [lexicons.CHAT_WORDS.get(w.upper(), w) for w in text.split()]
    text = " ".join(words).replace(":", " ").replace("_", " ")
    return " ".join(text.replace('"', "").replace("'", "").split())


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.text(alphabet=" \t\n \xa0abLOWl<>/:_\".,htpsw", max_size=40)
        | st.sampled_from(["BTW now", "see http://a.b/c <b>x</b>", "www.x.y", "lol lol,"]),
        min_size=1,
        max_size=30,
    )
)
def test_against_plain_python(spark, texts):
    assert apply(spark, N.normalize_text, texts) == [slow_normalize(t) for t in texts]


def test_normal_text_is_left_alone(spark):
    # a tag broken by a newline is whole once the newline is gone
    clean = [out for _, out in GOLDEN if "<" not in out and out == out.lower()]
    once = apply(spark, N.normalize_text, clean)
    assert once == clean
    assert apply(spark, N.normalize_text, once) == once


def test_rounding_follows_the_binary_value(spark):
    values = [0.125, 2.675, 2.175, 1.005, 1234.565, 3.0, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in rows.select(round_binary(F.col("v"), 2)).collect()]
    assert got == [round(v, 2) for v in values]
