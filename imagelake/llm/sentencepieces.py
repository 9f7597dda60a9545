"""SentencePiece encoding and decoding by a streaming Viterbi.

The lattice has an arc for each piece of the vocabulary (and one for each code point outside it, which becomes
its UTF-8 bytes where the model has byte pieces). At each position the best piece that ends there is kept as a
backpointer:

* unigram models: the one with the largest sum of scores;
* BPE models: the one that may follow the best piece before it. Merging a text yields the pieces p1 ... pn
  exactly if merging each pair p(i) p(i+1) alone yields that pair, because merges on either side of a boundary
  don't see each other until one crosses it. So every prefix has one valid last piece, and whether two pieces
  may meet is a question about two pieces, answered by merging those few characters.

A later piece can start only within the last `longest piece` positions, so the paths that survive are those
from these positions. Whenever all of them run through one boundary, the ids before it are final: they are
committed and the window moves up. Where no piece holds a space after another character, such a boundary lies
before every space that follows one; ids of short stretches between two such boundaries are kept in a bounded table.
Within a short stretch, all paths also run through a boundary between two characters that stand together in no piece; ids
of the parts between those are kept as well, as new stretches are often made of known parts.

Defined results: a null or empty text has no ids; all other texts encode as the reference implementation does
with default options; U+2581 in a text is a space to the model, so it decodes as one; equal rows get equal
results; an empty table gives an empty result; columns other than those carried are not read.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.common import released

SPACE = "▁"
_NEVER = float("-inf")
#: Default vocabulary file; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: (number, value)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """A vocabulary with its kind and normalisation, read from the bytes of a .model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.bpe = {1: False, 2: True}[trainer.get(3, 1)]
        self.dummy_prefix = bool(normalizer.get(3, 1))
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation without removal of white space is supported")
        if USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces are not supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.decoded = [
            b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.decoded.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


class Viterbi:
    """Encodes a text that arrives in parts; `push` and `finish` return the ids committed so far.

    For each position of the window: the id of the best piece that ends there (below -1: the code point
    -2 - id, which no piece holds), and where that piece starts."""

    def __init__(self, model: Model, check_every: int = 64, max_pairs: int = 1 << 20):
        self.m, self.check_every, self.max_pairs = model, check_every, max_pairs
        self.pairs: dict[int, bool] = {}
        self.timelines: tuple[dict, dict] = {}, {}  # of a piece's left and right end; both at most the vocabulary
        self.whole: dict[str, bool] = {}
        self.worst = min((model.scores[i] for i in model.ids.values()), default=0.0) - 10.0
        self.matcher = ahocorasick.Automaton()  # finds all pieces that end at a position, longest first
        for piece, i in model.ids.items():
            self.matcher.add_word(piece, (i, len(piece)))
        self.matcher.make_automaton()
        self.joined = {piece[i : i + 2] for piece in model.ids for i in range(len(piece) - 1)}  # neighbours in some piece
        self.reset()

    def reset(self) -> None:
        self.text, self.back, self.last, self.best = "", [0], [-1], [0.0]

    def string(self, i: int) -> str:
        return self.m.pieces[i] if i >= 0 else "" if i == -1 else chr(-2 - i)

    # -- which pieces may meet

    def timeline(self, piece: str, side: int) -> list[tuple[float, str]]:
        """The merges of a piece on its own, in order: (score, then the symbol at its right or left end)."""
        known = self.timelines[side].get(piece)
        if known is None:
            symbols, ids, scores, known = list(piece), self.m.ids, self.m.scores, []
            while len(symbols) > 1:
                top, at = None, -1
                for i in range(len(symbols) - 1):
                    k = ids.get(symbols[i] + symbols[i + 1])
                    if k is not None and (top is None or scores[k] > top):
                        top, at = scores[k], i
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                known.append((top, symbols[-1 if side else 0]))
            self.whole[piece] = len(symbols) == 1
            self.timelines[side][piece] = known
        return known

    def alone(self, piece: str) -> bool:
        """Whether merging the piece's own characters yields it."""
        known = self.whole.get(piece)
        if known is None:
            self.timeline(piece, 1)
            known = self.whole[piece]
        return known

    def meet(self, a: str, b: str) -> bool:
        """Whether merging a + b never crosses the boundary between them: replays the merges of both sides, best
        first and leftmost among equals, and looks whether the pair at the boundary would come before them."""
        if not (self.alone(a) and self.alone(b)):
            return False
        left, right, ids, scores = self.timeline(a, 1), self.timeline(b, 0), self.m.ids, self.m.scores
        x, y, i, j = a[-1], b[0], 0, 0
        while True:
            k = ids.get(x + y)
            s, t = left[i][0] if i < len(left) else _NEVER, right[j][0] if j < len(right) else _NEVER
            if k is not None and scores[k] > s and scores[k] >= t:
                return False
            if s >= t:
                if s == _NEVER:
                    return True
                x = left[i][1]
                i += 1
            else:
                y = right[j][1]
                j += 1

    def may_follow(self, a: int, b: int) -> bool:
        """a: the id before, -1 at the start."""
        if len(self.pairs) >= self.max_pairs:
            self.pairs.clear()
        x, y = self.string(a), self.string(b)
        known = self.pairs[a << 32 | b] = self.meet(x, y) if x else self.alone(y)
        return known

    # -- the lattice

    def push(self, part: str) -> list[int]:
        """part: normalised text."""
        out: list[int] = []
        for at in range(0, len(part), self.check_every):
            done = len(self.text)
            self.text += part[at : at + self.check_every]
            (self.extend_bpe if self.m.bpe else self.extend_unigram)(done)
            if len(self.text) >= self.check_every:
                out += self.commit()
        return out

    def extend_bpe(self, done: int) -> None:
        text, back, last, pairs, may_follow = self.text, self.back, self.last, self.pairs, self.may_follow
        start = max(0, done - self.m.longest + 1)
        n = done  # positions known so far
        for end, (i, size) in self.matcher.iter(text, start) if start else self.matcher.iter(text):
            if end < n:
                continue
            end += 1
            while n + 1 < end:  # a code point that no piece ends with
                n += 1
                back.append(n - 1)
                last.append(-2 - ord(text[n - 1]))
            j = end - size
            before = last[j]
            fits = pairs.get(before << 32 | i)
            if may_follow(before, i) if fits is None else fits:
                back.append(j)
                last.append(i)
                n = end
        while n < len(text):
            n += 1
            back.append(n - 1)
            last.append(-2 - ord(text[n - 1]))

    def extend_unigram(self, done: int) -> None:
        text, back, last, best, scores = self.text, self.back, self.last, self.best, self.m.scores
        start, found = max(0, done - self.m.longest + 1), {}
        for end, match in self.matcher.iter(text, start) if start else self.matcher.iter(text):
            found.setdefault(end + 1, []).append(match)
        for n in range(done + 1, len(text) + 1):
            ways = [(best[n - size] + scores[i], size, i) for i, size in found.get(n, ())]
            if all(size > 1 for _, size, _ in ways):
                ways.append((best[n - 1] + self.worst, 1, -2 - ord(text[n - 1])))
            score, size, i = max(ways)
            best.append(score)
            back.append(n - size)
            last.append(i)

    def short(self, text: str) -> list[int]:
        """Ids of a text that fits the window, of which nothing was pushed."""
        self.text = text
        (self.extend_bpe if self.m.bpe else self.extend_unigram)(0)
        out = self.path(len(text))
        self.reset()
        return out

    def parts(self, text: str) -> list[str]:
        """The text cut at boundaries that no piece spans, so that each part's ids depend on it alone."""
        joined, out, at = self.joined, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joined:
                out.append(text[at:i])
                at = i
        out.append(text[at:])
        return out

    def commit(self) -> list[int]:
        """Ids up to the last boundary that all surviving paths share."""
        n = len(self.text)
        alive = set(range(max(0, n - self.m.longest + 1), n + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(self.back[last])
        return self.cut(alive.pop())

    def path(self, end: int) -> list[int]:
        """Ids of the best path to a position."""
        out: list[int] = []
        back, last, at = self.back, self.last, end
        while at > 0:
            i = last[at]
            if i >= 0:
                out.append(i)
            elif self.m.bytes:
                out += [self.m.bytes[b] for b in reversed(chr(-2 - i).encode())]
            else:
                out.append(self.m.unknown)
            at = back[at]
        out.reverse()
        return out

    def cut(self, end: int) -> list[int]:
        out, back, last = self.path(end), self.back, self.last
        self.text = self.text[end:]
        self.back = [max(0, b - end) for b in back[end:]]
        self.last = last[end:]
        self.best = [b - self.best[end] for b in self.best[end:]] if not self.m.bpe else [0.0]
        return out

    def finish(self) -> list[int]:
        out = self.cut(len(self.text))
        self.reset()
        return out


class Encoder:
    """Ids of a text that arrives in parts of any size; `push` and `finish` return those that are final, packed as 32-bit
    integers.

    Where no piece holds a space after another character, no path spans the boundary before a space: all that survive
    run through it, so it is committed as soon as the space arrives. Ids between two committed boundaries depend on
    what stands between them alone, so those of short stretches after one space are kept in a table of bounded size, and
    those of their parts in another.
    A stretch that grows beyond `max_word` goes to the lattice as it comes, and is committed where its paths meet.
    What is retained is one short stretch or the lattice's window, never the text."""

    def __init__(self, model: Model, max_words: int = 250_000, max_word: int = 40, part: int = 1 << 16):
        self.m, self.viterbi, self.part = model, Viterbi(model), part
        self.max_words, self.max_word = max_words, max_word
        self.by_space = model.dummy_prefix and not model.inner_space
        encoder = self

        class Known(dict):
            """Packed ids of stretches that begin with one space."""

            def __missing__(self, word: str) -> bytes:
                packed = encoder.lattice(1, word)
                if len(word) <= encoder.max_word:
                    if len(self) >= encoder.max_words:
                        self.clear()
                    self[word] = packed
                return packed

        class Parts(dict):
            """Packed ids of parts that no piece goes beyond."""

            def __missing__(self, part: str) -> bytes:
                if len(self) >= encoder.max_words:
                    self.clear()
                packed = self[part] = array("i", encoder.viterbi.short(part)).tobytes()
                return packed

        self.known, self.parts = Known(), Parts()
        self.reset()

    def reset(self) -> None:
        # Spaces before the open stretch (the first is the prefix), its other characters, whether the lattice has begun it.
        self.spaces, self.open, self.begun = 1, "", False

    def lattice(self, spaces: int, rest: str, close: bool = True) -> bytes:
        if close and not self.begun and spaces + len(rest) <= self.max_word:
            return b"".join(map(self.parts.__getitem__, self.viterbi.parts(SPACE * spaces + rest)))
        ids = []
        for at in range(0, spaces, self.part):
            ids += self.viterbi.push(SPACE * min(self.part, spaces - at))
        ids += self.viterbi.push(rest)
        if close:
            ids += self.viterbi.finish()
        return array("i", ids).tobytes()

    def push(self, part: str) -> bytes:
        if not self.by_space:
            prefix = self.m.dummy_prefix and not self.begun
            self.begun = True
            return self.lattice(int(prefix), part.replace(" ", SPACE), False)
        words = part.replace(SPACE, " ").split(" ")
        words[0] = self.open + words[0]
        self.open = words.pop()
        if self.spaces == 1 and not self.begun and "" not in words:
            out = b"".join(map(self.known.__getitem__, words))
        else:
            made = []
            for w in words:
                if self.begun:
                    made.append(self.lattice(0, w))
                    self.begun, self.spaces = False, 1
                elif w:
                    made.append(self.known[w] if self.spaces == 1 else self.lattice(self.spaces, w))
                    self.spaces = 1
                else:
                    self.spaces += 1
            out = b"".join(made)
        if len(self.open) > self.max_word:
            out += self.lattice(0 if self.begun else self.spaces, self.open, False)
            self.open, self.begun = "", True
        return out

    def finish(self) -> bytes:
        if self.begun:
            out = self.lattice(0, self.open)
        else:
            out = self.known[self.open] if self.open and self.spaces == 1 else self.lattice(self.spaces, self.open)
        self.reset()
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if len(text) <= self.part:
            return self.push(text) + self.finish()
        return b"".join(self.push(text[at : at + self.part]) for at in range(0, len(text), self.part)) + self.finish()


_ready: dict[bytes, Encoder] = {}


def ready(data: bytes) -> Encoder:
    """The encoder of a model file's bytes. A worker process keeps its last one, with the stretches it knows, for the
    tasks that it runs later."""
    name = hashlib.blake2b(data).digest()
    if name not in _ready:
        _ready.clear()
        _ready[name] = Encoder(Model(data))
    _ready[name].viterbi.reset()
    _ready[name].reset()
    return _ready[name]


def load_model(spark, path: str) -> bytes:
    """The file's bytes, by Spark's reader or from the driver's own disk; a vocabulary is a few MB at most."""
    if "://" in path and not path.startswith("file:"):
        return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    with open(path.removeprefix("file://"), "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `carry`, ids array<int>, n_ids, and round_trip: whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(docs.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ready(shared.value)
        m = encoder.m
        for b in batches:
            texts = b.column("_text").to_pylist()
            packed = [encoder.encode(t or "") for t in texts]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            same = [m.decode(np.frombuffer(p, np.int32).tolist()) == (t or "") for p, t in zip(packed, texts, strict=True)]
            n = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), ids, n, pa.array(same)], [*carry, "ids", "n_ids", "round_trip"])

    source = docs.select(*carry, F.col("text").alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(released(run), f"{ddl}, ids array<int>, n_ids long, round_trip boolean")


def decode(rows: DataFrame, model: str = MODEL, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `carry` and text, from a column ids; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(load_model(rows.sparkSession, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ready(shared.value).m
        for b in batches:
            texts = [None if ids is None else m.decode(ids) for ids in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(texts, pa.string())], [*carry, "text"])

    source = rows.select(*carry, F.col("ids").alias("_ids"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(released(run), f"{ddl}, text string")
