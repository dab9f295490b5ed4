"""Encodes texts with a merge-type SentencePiece model, and decodes ids.

Merging the best pair again and again gives one token sequence: the only one in
which no two neighbours would have merged across their border. So a sequence can
be searched from the left. At each place the longest piece is tried; it stays if
the piece before it tolerates it, else its next shorter prefix is tried, and where
none fits, the place is marked as failed and the piece before is taken back.
Whether two pieces tolerate each other follows from merging both again.

A text falls into stretches that no piece reaches across, its words with the blanks
before them. A word is encoded once for all its occurrences in a task, and all new
words of a batch are searched side by side in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

BLANK = "▁"
REPLACEMENT = "�".encode()
#: Words whose ids a task keeps; slots for pairs of pieces whose verdict it keeps (a power of two).
HELD_WORDS, HELD_PAIRS = 1 << 19, 1 << 20
#: Characters of new words that are searched together.
MOST_CHARS = 1 << 20


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


# -- the model -------------------------------------------------------------


@dataclass
class Model:
    """Pieces of a merge-type model as arrays. Symbol ``len(pieces)`` is any character that no piece is made of."""

    pieces: list[str]  # texts of pieces that merging can reach, "" for others
    surface: list[bytes]  # what an id reads as; bytes and control ids are empty
    rank: np.ndarray  # order of the merge that makes a piece, -1 for single characters
    left: np.ndarray  # the two parts of that merge; a character is its own part
    right: np.ndarray
    prefix: np.ndarray  # the next shorter prefix that is a piece, or -1
    pair_keys: np.ndarray  # sorted: left * (symbols) + right of all pairs that merge
    pair_ranks: np.ndarray
    byte_ids: np.ndarray  # id of each byte value
    end_id: int
    unknown_id: int

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """All pieces of two or more characters."""
        automaton = ahocorasick.Automaton()
        # the automaton looks through a node's branches in the order they came: the separator and other
        # frequent strange characters go first, or each of them would pass all other characters
        used = set("".join(self.pieces))
        for strange in [c for c in map(chr, range(128)) if c not in used]:
            automaton.add_word(strange, len(self.pieces))
        for number, piece in enumerate(self.pieces):
            if len(piece) > 1:
                automaton.add_word(piece, number)
        automaton.make_automaton()
        return automaton

    @cached_property
    def single(self) -> np.ndarray:
        """Symbol of every character."""
        table = np.full(0x110000, len(self.pieces), np.int32)
        for number, piece in enumerate(self.pieces):
            if len(piece) == 1:
                table[ord(piece)] = number
        return table

    def symbols_of(self, text: str) -> np.ndarray:
        return self.single[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([*map(len, self.pieces), 1], np.int64)

    @cached_property
    def separator(self) -> str:
        used = set("".join(self.pieces))
        return next(c for c in map(chr, range(0x110000)) if c not in used)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("matcher", "single", "lengths", "separator")}


def read_model(path: str) -> Model:
    """Tables of a model file. Other kinds of models and of normalisation are refused."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    trainer, normal = proto.trainer_spec, proto.normalizer_spec
    kinds = proto.SentencePiece
    if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
        raise ValueError("a merge-type model with byte fallback is needed")
    plain = not normal.precompiled_charsmap and normal.add_dummy_prefix and normal.escape_whitespaces
    if not plain or normal.remove_extra_whitespaces:
        raise ValueError("a model without normalisation, with a blank before the text, is needed")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
        raise ValueError("user-defined and unused pieces are not supported")

    normals = {p.piece: (k, p.score) for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
    if any(BLANK in p.lstrip(BLANK) for p in normals):
        raise ValueError("pieces that reach across words are not supported")
    order = {s: k for k, s in enumerate(sorted({s for _, s in normals.values()}, reverse=True))}
    ranks = {p: order[s] for p, (_, s) in normals.items() if len(p) > 1}
    missing = {c for p in normals for c in p} - normals.keys()
    if missing:
        raise ValueError("pieces of characters that are no pieces are not supported")

    symbols = len(proto.pieces) + 1
    pieces, surface = [""] * (symbols - 1), [b""] * (symbols - 1)
    rank = np.full(symbols, -1, np.int64)
    left, right = np.arange(symbols), np.arange(symbols)
    prefix = np.full(symbols, -1, np.int64)
    byte_ids = np.zeros(256, np.int64)
    for k, p in enumerate(proto.pieces):
        if p.type == kinds.BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = k
        elif p.type == kinds.UNKNOWN:
            surface[k] = trainer.unk_surface.encode()
        elif p.type == kinds.NORMAL:
            surface[k] = p.piece.replace(BLANK, " ").encode()
    keys, values = [], []
    for piece, (k, _) in normals.items():
        if len(piece) > 1:
            last = _last_merge(piece, ranks, len(order))
            if last is None:
                continue  # merging never makes it
            left[k], right[k], rank[k] = normals[last[0]][0], normals[last[1]][0], ranks[piece]
        pieces[k] = piece
    for k, piece in enumerate(pieces):
        if len(piece) > 1:
            if rank[k] < max(rank[left[k]], rank[right[k]]):
                raise ValueError(f"piece {k} ranks before its parts")
            shorter = (normals.get(piece[:n], (-1,))[0] for n in range(len(piece) - 1, 0, -1))
            prefix[k] = next((s for s in shorter if s >= 0 and pieces[s]), -1)
            for n in range(1, len(piece)):
                a, b = normals.get(piece[:n], (-1,))[0], normals.get(piece[n:], (-1,))[0]
                if a >= 0 and b >= 0 and pieces[a] and pieces[b]:
                    keys.append(a * symbols + b)
                    values.append(rank[k])
    order_of_keys = np.argsort(np.array(keys, np.int64))
    return Model(
        pieces,
        surface,
        rank,
        left,
        right,
        prefix,
        np.array(keys, np.int64)[order_of_keys],
        np.array(values, np.int64)[order_of_keys],
        byte_ids,
        trainer.eos_id,
        trainer.unk_id,
    )


def _last_merge(piece: str, ranks: dict[str, int], far: int) -> tuple[str, str] | None:
    """The two parts that plain merging joins last to make a piece, or None. All ranks are below ``far``."""
    parts = list(piece)
    while len(parts) > 2:
        unions = [ranks.get(a + b, far) for a, b in zip(parts, parts[1:])]
        best = unions.index(min(unions))
        if unions[best] == far:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


# -- whether two neighbours would merge ------------------------------------


def tolerated(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of symbols: does merging the text of both again give just these two?

    Both are taken apart in the reverse order of their merges. Each pair that lay at the
    border must not have merged before the next merge took one of its sides away. Of
    equal ranks the left merge comes first, so it is undone last.
    """
    symbols = len(model.rank)
    good = np.ones(len(a), bool)
    at = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), np.iinfo(np.int64).max)
    while len(at):
        keys = a * symbols + b
        k = np.minimum(np.searchsorted(model.pair_keys, keys), len(model.pair_keys) - 1)
        joins = (model.pair_keys[k] == keys) & (2 * model.pair_ranks[k] < limit)
        good[at[joins]] = False
        rank_a, rank_b = model.rank[a], model.rank[b]
        on = ~joins & ((rank_a >= 0) | (rank_b >= 0))
        at, a, b, rank_a, rank_b = at[on], a[on], b[on], rank_a[on], rank_b[on]
        undo_b = rank_b >= rank_a
        limit = np.where(undo_b, 2 * rank_b + 1, 2 * rank_a)
        a, b = np.where(undo_b, a, model.right[a]), np.where(undo_b, model.left[b], b)
    return good


class Verdicts:
    """``tolerated`` with a memory of fixed size; a slot holds the last pair that fell on it."""

    def __init__(self, model: Model, slots: int = HELD_PAIRS):
        self.model = model
        self.keys = np.full(slots, -1, np.int64)
        self.good = np.zeros(slots, bool)
        self.shift = np.uint64(64 - (slots.bit_length() - 1))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * len(self.model.rank) + b
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        slot = slot.astype(np.int64)
        good = self.good[slot]
        new = np.flatnonzero(self.keys[slot] != keys)
        if len(new):
            found = tolerated(self.model, a[new], b[new])
            good[new] = found
            self.keys[slot[new]] = keys[new]
            # of several pairs on one slot the last stays, in both arrays
            self.good[slot[new]] = found
        return good


# -- the search ------------------------------------------------------------


def _hits(found: Iterable[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last character, piece) of an automaton's matches."""
    flat = np.fromiter(chain.from_iterable(found), np.int64)
    return flat[0::2], flat[1::2]


def search(model: Model, verdicts: Verdicts, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, characters where they begin, number of symbols per word) of words that no piece reaches across."""
    joined = model.separator.join(words) + model.separator
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1  # places of the separators

    # a first walk: the longest piece at each place, one after the other
    last, found = _hits(model.matcher.iter_long(joined))
    first = last + 1 - model.lengths[found]
    single = model.symbols_of(joined)
    token = single.copy()  # symbol that begins at a place
    token[first] = found
    inside = np.zeros(len(joined) + 1, np.int8)
    inside[first + 1] += 1
    inside[last + 1] -= 1
    path = np.cumsum(inside[:-1], dtype=np.int8) == 0  # where a symbol of the sequence begins
    path[ends] = False
    places = np.flatnonzero(path)
    word = np.repeat(np.arange(len(words)), np.diff(np.cumsum(path)[ends], prepend=0))

    # words in which neighbours do not tolerate each other are searched on from there
    inner = np.flatnonzero(word[1:] == word[:-1])
    wrong = inner[~verdicts(token[places[inner]], token[places[inner + 1]])]
    if len(wrong):
        back = np.full(len(joined), -1, np.int64)  # where the symbol before a place begins
        back[places[inner + 1]] = places[inner]
        changed, at = np.unique(word[wrong], return_index=True)
        starts = places[wrong[at] + 1]
        path[_ragged(starts, ends[changed] - starts)] = False
        _backtrack(model, verdicts, [words[k] for k in changed], starts, ends[changed], token, path, back, single)
        places = np.flatnonzero(path)
    return token[places], places, np.diff(np.cumsum(path)[ends], prepend=0)


def _backtrack(
    model: Model,
    verdicts: Verdicts,
    words: list[str],
    starts: np.ndarray,
    ends: np.ndarray,
    token: np.ndarray,
    path: np.ndarray,
    back: np.ndarray,
    longest: np.ndarray,
) -> None:
    """Search words side by side from given places to their ends; changes ``token``, ``path``, ``back`` and ``longest``.

    ``longest`` comes with the symbol of each place's character and gets the longest piece.
    Every turn each word tries one piece at its place: it goes on, tries the next shorter
    piece, or marks the place as failed and takes its last piece back.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    shift = np.repeat(ends + 1 - np.cumsum(sizes), sizes)  # from places among these words to places among all
    last, found = _hits(model.matcher.iter(model.separator.join(words)))
    first = last + 1 - model.lengths[found]
    longest[first + shift[first]] = found  # matches come by their end, so the longest is written last
    failed = np.zeros(len(token), bool)

    place, stop = starts.copy(), ends
    trial = longest[place]
    while len(place):
        ahead = place + model.lengths[trial]
        fits = ~failed[ahead]
        before = back[place]
        asks = np.flatnonzero(fits & (before >= 0))
        fits[asks] = verdicts(token[before[asks]], trial[asks])
        go, stay = np.flatnonzero(fits), np.flatnonzero(~fits)
        here, there = place[go], ahead[go]
        token[here] = trial[go]
        path[here] = True
        back[there] = here
        place[go] = there
        shorter = model.prefix[trial[stay]]
        trial[go] = longest[there]
        trial[stay] = shorter
        stuck = stay[shorter < 0]
        failed[place[stuck]] = True
        home = back[place[stuck]]
        path[home] = False
        place[stuck], trial[stuck] = home, token[home]
        on = np.flatnonzero(place < stop)
        if len(on) < len(place):
            place, stop, trial = place[on], stop[on], trial[on]


# -- texts -----------------------------------------------------------------


class Numbers(dict):
    """Numbers for words in the order of their first look-up."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, word) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes texts in a task. Words seen before keep their ids until too many are held."""

    def __init__(self, model: Model, held_words: int = HELD_WORDS):
        self.model, self.held_words = model, held_words
        self.verdicts = Verdicts(model)
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.numbers[0] = 0  # the end, no word
        self.ids = [np.array([self.model.end_id], np.int32)]
        self.counts = [np.ones(1, np.int64)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); an end id after each text."""
        if len(self.numbers) > self.held_words:
            self._forget()
        look = self.numbers.__getitem__
        found, sizes = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = split(text)
            numbers = np.fromiter(map(look, words), np.int64, len(words))
            found.append(numbers)
            found.append(np.zeros(1, np.int64))
            sizes[k] = len(words) + 1
        self._learn()
        order = np.concatenate(found) if found else np.zeros(0, np.int64)
        ids, counts = np.concatenate(self.ids), np.concatenate(self.counts)
        self.ids, self.counts = [ids], [counts]
        begins = np.cumsum(counts) - counts
        out = ids[_ragged(begins[order], counts[order])]
        ends = np.concatenate(([0], np.cumsum(counts[order])))
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        return out, np.diff(ends[cuts])

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        at = 0
        while at < len(new):
            to, chars = at, 0
            while to < len(new) and (to == at or chars + len(new[to]) < MOST_CHARS):
                chars += len(new[to]) + 2
                to += 1
            words = [BLANK + w.replace(" ", BLANK) for w in new[at:to]]
            symbols, places, counts = search(self.model, self.verdicts, words)
            self._keep(words, symbols, places, counts)
            at = to

    def _keep(self, words: list[str], symbols: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        """Store ids of new words, with the bytes of unknown characters in their place."""
        strange = np.flatnonzero(symbols == len(self.model.pieces))
        if len(strange):
            joined = self.model.separator.join(words)
            spelled = [self.model.byte_ids[list(joined[p].encode())] for p in places[strange]]
            width = np.ones(len(symbols), np.int64)
            width[strange] = [len(s) for s in spelled]
            owner = np.repeat(np.arange(len(words)), counts)
            counts = np.bincount(owner, width, len(words)).astype(np.int64)
            at = np.cumsum(width) - width
            symbols = np.repeat(symbols, width)
            symbols[_ragged(at[strange], width[strange])] = np.concatenate(spelled)
        self.ids.append(symbols.astype(np.int32))
        self.counts.append(counts)


def split(text: str) -> list[str]:
    """Words of a text with the blanks before them, but for one blank each."""
    if not text:
        return []
    if BLANK in text:
        text = text.replace(BLANK, " ")
    if "  " not in text and text[0] != " ":
        return text.split(" ")
    words, waiting = [], 0
    for word in text.split(" "):
        if word:
            words.append(" " * waiting + word)
            waiting = 0
        else:
            waiting += 1
    if waiting:
        words.append(" " * (waiting - 1))
    return words


class Decoder:
    """Texts of id sequences."""

    def __init__(self, model: Model):
        self.model = model
        surface = list(model.surface)
        for value, number in enumerate(model.byte_ids):
            surface[number] = bytes([value])
        self.lengths = np.fromiter(map(len, surface), np.int64, len(surface))
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.is_byte = np.zeros(len(surface), bool)
        self.is_byte[model.byte_ids] = True
        # pieces that open with a blank lose it at the start of a text; the unknown sign does not
        self.opens = np.array([p.startswith(BLANK) for p in model.pieces])
        self.silent = self.lengths == 0

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Text (UTF-8) of each run of ids. Bytes that are no character become replacement signs."""
        begins, lengths = self.begins[ids], self.lengths[ids]
        ends = np.cumsum(counts)
        # the first id of a text that says something
        loud = np.flatnonzero(~self.silent[ids])
        k = np.searchsorted(loud, ends - counts)
        there = k < len(loud)
        first = loud[np.minimum(k, len(loud) - 1)] if len(loud) else k
        there &= first < ends
        first = first[there]
        cut = first[self.opens[ids[first]]]
        begins[cut] += 1
        lengths[cut] -= 1
        data = self.flat[_ragged(begins, lengths)].tobytes()
        sums = np.concatenate(([0], np.cumsum(lengths)))
        borders = sums[np.concatenate(([0], ends))].tolist()
        texts = [data[a:b] for a, b in zip(borders, borders[1:])]
        try:
            data.decode()
        except UnicodeDecodeError:
            edges = np.concatenate(([0], ends)).tolist()
            for t, text in enumerate(texts):
                try:
                    text.decode()
                except UnicodeDecodeError:
                    mine = slice(edges[t], edges[t + 1])
                    texts[t] = self._mended(text, self.is_byte[ids[mine]], lengths[mine])
        return texts

    def _mended(self, text: bytes, is_byte: np.ndarray, lengths: np.ndarray) -> bytes:
        out, at, run = [], 0, b""
        for byte, n in zip(is_byte.tolist(), lengths.tolist()):
            part, at = text[at : at + n], at + n
            if byte:
                run += part
            else:
                out += [valid_utf8(run), part]
                run = b""
        return b"".join([*out, valid_utf8(run)])


def valid_utf8(data: bytes) -> bytes:
    """Whole characters as they are, a replacement sign for every other byte."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                data[at : at + n].decode()
                out.append(data[at : at + n])
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(REPLACEMENT)
            at += 1
    return b"".join(out)


# -- tables ----------------------------------------------------------------


def public_model() -> str:
    """The place of a public merge-type model with 32,000 pieces."""
    import public_tokenizers  # beside the installed libraries; callers with models of their own do not need it

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every document's whole text, with an end id. A null text is an empty one: the end alone.

    Rows stay where they are; repeated rows give the same ids. Only the two named columns are
    read. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    ids = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)
    schema = T.StructType([rows.schema["doc_id"], ids])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # the model's pieces

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [t.as_py().decode("utf-8", "replace") for t in batch.column(1)]
            found, counts = encoder.encode(texts)
            ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: Model, ids_col: str = "ids") -> DataFrame:
    """Replace the column of ids by the column ``decoded``, their text; null ids give a null text."""
    kept = [f for f in rows.schema.fields if f.name != ids_col]
    ordered = rows.select(*(f.name for f in kept), ids_col)
    schema = T.StructType([*kept, T.StructField("decoded", T.BinaryType())])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # the model's pieces

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(len(kept))
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), counts.astype(np.int64))
            whole = pa.array(texts, pa.binary(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], whole], [f.name for f in schema.fields])

    return ordered.mapInArrow(run, schema).withColumn("decoded", F.col("decoded").cast("string"))


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; see ``encoded`` and ``decoded``."""
    model = read_model(path)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    ids = encoded(docs, model, id_col, text_col).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), "ids"
    )
    return decoded(ids, model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
