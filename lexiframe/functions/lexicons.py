"""Dictionaries. Fixed values and the rules that expand them."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Chat shorthand and its expansions.
CHAT_WORDS = {
    "AFAIK": "As Far As I Know",
    "AFK": "Away From Keyboard",
    "ASAP": "As Soon As Possible",
    "BRB": "Be Right Back",
    "BTW": "By The Way",
    "FAQ": "Frequently Asked Questions",
    "FYA": "For Your Action",
    "FYI": "For Your Information",
    "GTG": "Got To Go",
    "ICYMI": "In Case You Missed It",
    "IDK": "I Don't Know",
    "IMHO": "In My Humble Opinion",
    "IMO": "In My Opinion",
    "LOL": "Laugh Out Loud",
    "OMG": "Oh My God",
    "TGIF": "Thank God It's Friday",
    "TMI": "Too Much Information",
    "TTYL": "Talk To You Later",
    "TTYT": "Talk To You Tomorrow",
}

# English auxiliaries that take n't, and the irregular ones.
NEGATABLE = (
    "are", "could", "did", "do", "does", "had", "has", "have", "is", "might", "must", "need",
    "ought", "should", "was", "were", "would",
)
IRREGULAR_CONTRACTIONS = {
    "can't": "cannot",
    "won't": "will not",
    "shan't": "shall not",
    "ain't": "are not",
    "let's": "let us",
    "ma'am": "madam",
    "o'clock": "of the clock",
    "y'all": "you all",
}
# Subjects and the verb endings each can take.
SUBJECT_ENDINGS = {
    "i": ("m", "ve", "ll", "d"),
    "you": ("re", "ve", "ll", "d"),
    "we": ("re", "ve", "ll", "d"),
    "they": ("re", "ve", "ll", "d"),
    "he": ("s", "ll", "d"),
    "she": ("s", "ll", "d"),
    "it": ("s", "ll", "d"),
    "that": ("s", "ll", "d"),
    "there": ("s", "ll", "d"),
    "who": ("s", "ll", "d", "ve"),
    "what": ("s", "ll", "re", "ve"),
    "where": ("s", "d"),
    "when": ("s",),
    "why": ("s",),
    "how": ("s", "d", "ll"),
    "here": ("s",),
    "could": ("ve",),
    "should": ("ve",),
    "would": ("ve",),
    "might": ("ve",),
    "must": ("ve",),
}
ENDINGS = {"m": "am", "re": "are", "ve": "have", "ll": "will", "d": "would", "s": "is"}


@lru_cache(maxsize=1)
def contractions() -> dict[str, str]:
    """Lower-case contraction -> expansion."""
    table = {f"{verb}n't": f"{verb} not" for verb in NEGATABLE}
    for subject, endings in SUBJECT_ENDINGS.items():
        for ending in endings:
            table[f"{subject}'{ending}"] = f"{subject} {ENDINGS[ending]}"
    table.update(IRREGULAR_CONTRACTIONS)
    return table


# Single code points and short runs that Unicode's emoji data lists as emoji.
SYMBOL_EMOJI = (
    "203C 2049 20E3 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB "
    "25B6 25C0 25FB-25FE "
    "2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 "
    "2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C "
    "26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 "
    "26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 "
    "2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF "
    "2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E "
    "1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F7E0-1F7EB 1F7F0"
)
# Pictograph blocks taken whole.
PICTOGRAPH_BLOCKS = "1F300-1F64F 1F680-1F6FF 1F900-1F9FF 1FA70-1FAFF"
# Names that differ from the Unicode character name.
EMOJI_NAMES = {
    0x2764: "red heart",
    0x1F44D: "thumbs up",
    0x1F44E: "thumbs down",
    0x1F525: "fire",
    0x1F64F: "folded hands",
    0x1F44F: "clapping hands",
    0x1F389: "party popper",
    0x1F4AF: "hundred points",
    0x1F680: "rocket",
    0x1F3FB: "light skin tone",
    0x1F3FC: "medium-light skin tone",
    0x1F3FD: "medium skin tone",
    0x1F3FE: "medium-dark skin tone",
    0x1F3FF: "dark skin tone",
}
EMOJI_BASE, EMOJI_END = 0x203C, 0x1FAFF
# The gap between the two groups of blocks holds no emoji.
EMOJI_GAP = (0x329A, 0x1F003)


def _code_points(spec: str):
    for part in spec.split():
        first, _, last = part.partition("-")
        yield from range(int(first, 16), int(last or first, 16) + 1)


@lru_cache(maxsize=1)
def emoji_names() -> dict[int, str]:
    """Code point -> name in words, from the Unicode character names."""
    table = {}
    for cp in (*_code_points(SYMBOL_EMOJI), *_code_points(PICTOGRAPH_BLOCKS)):
        name = EMOJI_NAMES.get(cp) or unicodedata.name(chr(cp), "").lower()
        if name:
            table[cp] = name
    return table


# English word classes for the lexicon tagger.
POS_WORDS = {
    "PRON": (
        "i you he she it we they me him her us them mine yours his hers ours theirs myself "
        "yourself himself herself itself ourselves themselves who whom whose which what this that "
        "these those someone anyone everyone nobody something anything everything nothing"
    ),
    "DET": "the a an my your our their its each every either neither some any no all both",
    "ADP": (
        "of in to for with on at from by about into over after under between through during "
        "before against among without within toward upon"
    ),
    "CCONJ": "and or but nor yet",
    "SCONJ": "because although though while if unless until since whether as than",
    "AUX": (
        "am is are was were be been being have has had do does did will would shall should can "
        "could may might must"
    ),
    "PART": "not t",
    "ADV": (
        "very too also just never always often here there now then soon again still already "
        "almost quite rather well up down out off away"
    ),
    "VERB": (
        "say said go went gone get got make made know knew think thought take took see saw come "
        "came want use used find found give gave tell told work call try ask need feel become "
        "leave put love loved hate like"
    ),
    "ADJ": (
        "good bad new old great big small large long short high low own other many few more most "
        "same able early late young important public little right"
    ),
    "INTJ": "oh ah hello hi hey yes please thanks wow",
}
# Word endings for words outside the lexicon, first match wins.
POS_SUFFIXES = (
    ("ADV", ("ly",)),
    ("NOUN", ("tion", "sion", "ment", "ness", "ity", "ism", "ance", "ence")),
    ("ADJ", ("ous", "ful", "ive", "able", "ible", "less", "ical")),
    ("VERB", ("ing", "ed", "ize", "ise", "ify")),
    ("NOUN", ("er", "or", "ist", "age", "ship")),
)

# Irregular lemmas.
LEMMAS = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be",
    "has": "have", "had": "have", "does": "do", "did": "do", "done": "do", "went": "go",
    "gone": "go", "got": "get", "made": "make", "said": "say", "knew": "know", "took": "take",
    "saw": "see", "came": "come", "found": "find", "gave": "give", "told": "tell",
    "thought": "think", "children": "child", "men": "man", "women": "woman", "feet": "foot",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad",
}

# Words that negate what follows.
NEGATION_CUES = ("not", "no", "never", "neither", "nor", "none", "cannot")

# Cell texts a delimited-file reader takes as missing.
NA_STRINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Words that mark a footer row.
FOOTER_WORDS = ("total", "summary", "remarks", "notes")
