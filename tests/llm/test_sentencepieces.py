"""The streaming encoder against the library that defines the format, and toy unigram models against brute force."""

import itertools
import random
import struct

import numpy as np
import pytest
import sentencepiece

from imagelake.llm import sentencepieces as sp

TEXTS = [
    "Hello  world\tab\n x", " a  ", "", "▁a", "<s> <0x41> \r\n", "   " * 20 + "x", " " * 100, "a" * 300, "日本語のテキスト 😀 ﬁ" * 5, "====----" * 30,
    "x=1;\n\n\n\t\tdef f(a):  return a**2\n", "\x00\x01", "é" * 50, "Überraschung! L'été — ça va?", "the quick brown fox " * 400,
]


@pytest.fixture(scope="module")
def model():
    with open(sp.MODEL, "rb") as f:
        return sp.Model(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def random_texts():
    rng = random.Random(1)
    return ["".join(rng.choice("ab  cd\ntheing▁é日-=") for _ in range(rng.randint(1, 90))) for _ in range(400)]


@pytest.mark.parametrize("every", [1, 5, 64])
def test_equals_the_library(model, library, every):
    encoder, viterbi = sp.Encoder(model), sp.Viterbi(model, check_every=every)
    for t in TEXTS + random_texts():
        want = library.encode(t)
        assert np.frombuffer(encoder.encode(t), np.int32).tolist() == want
        assert viterbi.push(model.normalise(t)) + viterbi.finish() == want
        assert model.decode(want) == library.decode(want)


@pytest.mark.parametrize("max_word,part", [(0, 1), (3, 2), (40, 7)])
def test_parts_of_any_size(model, library, max_word, part):
    encoder = sp.Encoder(model, max_words=5, max_word=max_word, part=part)
    rng = random.Random(part)
    for t in TEXTS + random_texts():
        assert np.frombuffer(encoder.encode(t), np.int32).tolist() == library.encode(t)
        out, at = b"", 0
        while at < len(t):
            n = rng.randint(0, 12)
            out += encoder.push(t[at : at + n])
            at += n
        assert np.frombuffer(out + (encoder.finish() if t else b""), np.int32).tolist() == library.encode(t)


def test_stream_retains_little_and_commits_early(model, library):
    """A stretch without spaces far longer than any window, then spaces, then words: ids come as the text does."""
    text = ("日本語abc-=" * 30_000) + " " * 50_000 + "some words " * 2000
    encoder, out, widest, late = sp.Encoder(model, part=512), 0, 0, 0
    for at in range(0, len(text), 512):
        out += len(encoder.push(text[at : at + 512])) // 4
        widest = max(widest, len(encoder.open) + len(encoder.viterbi.text))
        if at == 512 * 400:
            late = out
    rest = len(encoder.finish()) // 4
    assert widest < 1000 and out + rest == len(library.encode(text)) and late > 50_000 and rest < 100


def test_window_stays_small(model):
    viterbi, widest = sp.Viterbi(model, check_every=8), 0
    for _ in range(300):
        viterbi.push("some words and a longish text that goes on ".replace(" ", sp.SPACE))
        widest = max(widest, len(viterbi.text))
    assert widest < 200


def toy(pieces):
    """A unigram model file with identity normalisation."""

    def field(number, payload):
        return bytes([number << 3 | 2, len(payload)]) + payload

    def piece(p, score, kind=1):
        return field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", score) + (b"\x18" + bytes([kind]) if kind != 1 else b""))

    data = piece("<unk>", 0.0, 2) + b"".join(piece(p, s) for p, s in pieces)
    return sp.Model(data + field(2, b"\x18\x01") + field(3, b"\x18\x00\x20\x00"))


def test_unigram_against_all_segmentations():
    rng = random.Random(5)
    pieces = [("".join(rng.choice("abc") for _ in range(n)), -rng.uniform(1, 6)) for n in (1, 1, 1, 2, 2, 3, 3, 4)]
    pieces = list(dict(pieces).items())
    m = toy(pieces)
    score = dict(pieces)
    worst = min(score.values()) - 10
    for _ in range(60):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        best = -1e9
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(text)]
            parts = [text[a:b] for a, b in zip([0, *ends], ends)]
            if all(p in score or len(p) == 1 for p in parts):
                best = max(best, sum(score.get(p, worst) for p in parts))
        v = sp.Viterbi(m, check_every=3)
        ids = v.push(text) + v.finish()
        assert sum(m.scores[i] if i else worst for i in ids) == pytest.approx(best, abs=1e-4)


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (1, "twice", "x"), (1, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sp.encode(df).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and r.doc_id != 1:
            assert list(r.ids) == library.encode(TEXTS[r.doc_id]) and r.n_ids == len(r.ids)
            assert r.round_trip == ("▁" not in TEXTS[r.doc_id])
    back = sp.decode(sp.encode(df)).filter("doc_id is not null and doc_id != 1").collect()
    assert all(r.text == TEXTS[r.doc_id].replace("▁", " ") for r in back)
    assert sp.encode(df.limit(0)).count() == 0


def test_stretches_are_cut_where_no_piece_goes(model, library):
    """Stretches made of known parts need no lattice; ids are the library's."""
    encoder, runs = sp.Encoder(model), []
    short = encoder.viterbi.short
    encoder.viterbi.short = lambda text: runs.append(text) or short(text)
    words = ["anelleaux", "iertre", "lacht", "über", "日本"]
    text = " ".join(w + end for w in words for end in ("", ".", "***", "%%%", ".%%%", "&&&,"))
    assert np.frombuffer(encoder.encode(text), np.int32).tolist() == library.encode(text)
    assert len(runs) == len(set(runs)) < 30  # one a stretch before
    for t in TEXTS + random_texts():
        parts = encoder.viterbi.parts(model.normalise(t))
        assert "".join(parts) == model.normalise(t)
        assert [i for p in parts if p for i in short(p)] == library.encode(t)
