from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lexiframe.llm import pieces as P

ODD = [
    "", "a", " a", "  a", "a  b", " ", "  ", "   " * 20, " " * 16 + "x", "a ", "▁", "▁▁a b ▁", "\n", "a\nb", "é", "日本語", "\x00a\x00",
    "<s></s><unk><0x0A>", "😀😀 x", "ß" * 40, "the" * 100, "word.Word", "1234 5678", "\t\ttab", " " * 11, " " * 37 + "ab", "a" * 300,
    "ab" * 500, "﷽�‍", "internationalization" * 20,
]


@pytest.fixture(scope="module")
def model():
    return P.read_model(P.public_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.public_model())


def same(model, library, texts, **more):
    ids, counts = P.Encoder(model, **more).encode(texts)
    want = [library.encode(t, add_eos=True) for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert [t.decode() for t in P.Decoder(model).decode(ids, counts)] == [library.decode(w) for w in want]


def test_odd_texts(model, library):
    same(model, library, ODD)


def test_random_texts(model, library):
    rng = random.Random(1)
    known = [p.replace(P.BLANK, " ") for p in model.pieces if p]
    same(model, library, ["".join(rng.choices("aehinorst ▁ .,é日語\n0", k=rng.randint(0, 60))) for _ in range(2000)])
    same(model, library, ["".join(rng.choices(known, k=rng.randint(1, 12))) for _ in range(2000)])
    same(model, library, ["".join(rng.choices("aei", k=200)) for _ in range(200)])


def test_words_that_need_pieces_taken_back(model, library):
    words = ["".join(random.Random(k).choices("etaoinshr", k=14)) for k in range(60)]
    failed = []
    for word in words:
        _, places, _ = P.search(model, P.Verdicts(model), [P.BLANK + word])
        greedy, at = [], 0
        while at < 15:
            greedy.append(at)
            at += max(len(p) for p in model.pieces if p and (P.BLANK + word).startswith(p, at))
        failed.append(greedy != places.tolist())
    assert sum(failed) > 5
    same(model, library, words)


def test_neighbours(model):
    """The unwinding agrees with merging both again."""
    rng = random.Random(2)
    rank = {p: int(model.rank[k]) for k, p in enumerate(model.pieces) if len(p) > 1}

    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            best = min((rank.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 40:
                return parts
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    known = [k for k, p in enumerate(model.pieces) if p]
    blanks = [k for k in known if set(model.pieces[k]) == {P.BLANK}]
    common = known[:600]
    draws = [(rng.choice(c), rng.choice(c)) for c in (known, common, blanks) for _ in range(600)]
    a, b = (np.array(x) for x in zip(*draws))
    got = P.tolerated(model, a, b)
    want = [merged(model.pieces[x] + model.pieces[y]) == [model.pieces[x], model.pieces[y]] for x, y in draws]
    assert got.tolist() == want and 0 < sum(want) < len(want)
    small = P.Verdicts(model, 64)  # slots are fought over
    for _ in range(2):
        assert small(a, b).tolist() == want


def test_decode_any_ids(model, library):
    rng = random.Random(4)
    decoder = P.Decoder(model)
    runs = [
        [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 30))]
        for _ in range(600)
    ]
    got = decoder.decode(np.array([x for r in runs for x in r], np.int32), np.array([len(r) for r in runs]))
    assert [t.decode() for t in got] == [library.decode(r) for r in runs]


def test_memory_limit_changes_nothing(model, library):
    encoder, texts = P.Encoder(model, held_words=3), ["one two three four five", "five six seven", "one " * 9]
    for _ in range(3):
        ids, counts = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_eos=True) for t in texts]


def test_table(docs, empty, pairs, library):
    out = P.piece_digests(docs, P.public_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def row(doc, text):
        ids = library.encode(text or "", add_eos=True)
        return doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))

    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted((row(d, t) for d, t in pairs), key=str)
    assert P.piece_digests(empty, P.public_model()).count() == 0


def test_null_ids(spark, model):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [1, 9, 2])], "decoded long, ids array<int>").withColumnRenamed("decoded", "x")
    assert {r.x: r.decoded for r in P.decoded(rows, model).collect()}[1] is None


def test_other_models_are_refused(tmp_path, model):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(P.public_model(), "rb") as file:
        proto.ParseFromString(file.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        P.read_model(str(tmp_path / "other.model"))
