"""Token ids as length-delimited binary records, with an offset index beside each file for shuffled reads.

A record is a frame around its data: the data's length (8 bytes), a masked checksum of the length (4), the data, and
a masked checksum of the data (4), all little-endian. Checksums are CRC-32C; a masked one is rotated and shifted by a
constant, so that data which holds checksums itself doesn't weaken them. The data of a document is one byte of flags
(1: it has an id; 2: wide tokens), its id (8 bytes), and its token ids (2 bytes each, or 4 where one needs more). The index of `x.rec` is `x.rec.idx`: one entry
of 24 bytes per record (place, tokens before it in the file, tokens), so any record can be read by itself.

Texts go by ranges of doc_id to as many tasks as there are shuffle partitions; each sorts its range (with spill),
encodes it and streams it into one file. Files are named by range, so the order of names is the order of ids, and a
file appears under its name only when whole: a task that is run again replaces or keeps it. A reader gets spans of
index entries, in any order, and checks the frame of each record. A task holds the ids of one document, a part of a
file's index, and a span of records of about SPAN bytes.

Encoding goes by the vocabulary's words: its rules drop white space, cut at letters, digits and marks, and join nothing
across words, so a text's ids are those of its words one after another. Texts are cut by columnar functions, first at
ASCII white space, then distinct stretches into words; the library's model encodes distinct words, and a worker keeps
the ids of MAX_KNOWN of them. Stretches with characters beyond the first Latin blocks, with rare separators, or with what
may be a special token, go to the library whole.

Defined results: a null or empty text is the end id alone; null doc_ids come first, then ascending doc_ids, texts of
one doc_id by their xxhash64, then by themselves; repeated rows are all written; an empty table gives no file and an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imagelake.llm.common import make_dir, scratch_path, table
from imagelake.llm.files import Placed, store

#: Bytes of texts or records that a task takes at once; a longer one is taken by itself.
SPAN = 4 << 20
#: Words whose ids a worker keeps, and the characters of the longest of them.
MAX_KNOWN, MAX_LENGTH = 1 << 20, 40
#: Characters of text that are encoded at once.
CHUNK = 8 << 20

# ---------------------------------------------------------------- checksums

#: The reversed polynomial of CRC-32C (Castagnoli) and the constant of masked checksums.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1)).astype(np.uint32)
    return t


def _shifted(zeros: int) -> np.ndarray:
    """Four tables by which a state passes over so many zero bytes: one for each of its bytes, highest last."""
    t, out = _byte_table(), []
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(zeros):
            state = t[state & np.uint32(255)] ^ (state >> np.uint32(8))
        out.append(state)
    return np.stack(out)


#: Bytes of a block: the states of all blocks of a batch advance side by side, and are then joined by _OVER.
_BLOCK = 512
_OVER = _shifted(_BLOCK)


def _pass(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    low, high = state & np.uint32(0xFFFF), state >> np.uint32(16)
    return tables[0][low & 255] ^ tables[1][low >> 8] ^ tables[2][high & 255] ^ tables[3][high >> 8]


def _halves(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as two tables by the low and the high half of a state."""
    return tuple((tables[k][None, :] ^ tables[k + 1][:, None]).ravel() for k in (0, 2))


_LOW, _HIGH = _halves(_shifted(4))


def crc32c(items: list[bytes]) -> np.ndarray:
    """CRC-32C of each item. Items are filled up with leading zero bytes to whole blocks; a state of zero isn't changed
    by these, so the first block that has data starts from the usual ones by another way: the effect of the initial
    ones on an item of n bytes is that of ones passed over n zero bytes, added at the end."""
    if not items:
        return np.empty(0, np.uint32)
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    blocks = -(-sizes // _BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    data = np.frombuffer(b"".join(x for item, n, k in zip(items, sizes.tolist(), blocks.tolist(), strict=True) for x in (bytes(k * _BLOCK - n), item)), "<u4")
    words = data.reshape(-1, _BLOCK // 4).T.copy()
    state = np.zeros(words.shape[1], np.uint32)
    for w in words:
        state ^= w
        state = _LOW[state & np.uint32(0xFFFF)] ^ _HIGH[state >> np.uint32(16)]
    # Joined per item from its first block on, all items side by side.
    out, live = np.zeros(len(items), np.uint32), np.arange(len(items))
    for k in range(int(blocks.max(initial=0))):
        live = live[blocks[live] > k]
        out[live] = _pass(_OVER, out[live]) ^ state[first[live] + k]
    return ~(out ^ _ones_over(sizes))


_powers: list[np.ndarray] = []


def _ones_over(sizes: np.ndarray) -> np.ndarray:
    """The state of ones after so many zero bytes, by the binary digits of the sizes."""
    state = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        if len(_powers) <= bit:
            last = _powers[-1] if _powers else None
            _powers.append(_shifted(1) if last is None else np.stack([_pass(last, t) for t in last]))
        hit = (sizes >> bit) & 1 == 1
        state[hit] = _pass(_powers[bit], state[hit])
    return state


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


# ---------------------------------------------------------------- frames

_HEAD, _ENTRY = struct.Struct("<QI"), np.dtype([("at", "<u8"), ("before", "<u8"), ("tokens", "<u8")])
#: Bytes of a frame besides its data, and of the data besides its token ids.
FRAME, OWN = 16, 9


def frames(data: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(x)) for x in data]
    of_length, of_data = masked(crc32c(lengths)).tolist(), masked(crc32c(data)).tolist()
    return [b"".join((n, struct.pack("<I", a), x, struct.pack("<I", b))) for n, a, x, b in zip(lengths, of_length, data, of_data, strict=True)]


def serialized(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) >> 16 > 0
    return struct.pack("<Bq", (doc_id is not None) + 2 * wide, doc_id or 0) + (ids if wide else ids.astype("<u2")).tobytes()


def parsed(data: bytes) -> tuple[int | None, bytes]:
    """The id of a document, and its token ids as 32-bit words."""
    flags, doc_id = struct.unpack_from("<Bq", data)
    tokens = data[OWN:] if flags & 2 else np.frombuffer(data, "<u2", offset=OWN).astype("<u4").tobytes()
    return doc_id if flags & 1 else None, tokens


def unframed(block: bytes, where: str) -> list[bytes]:
    """The data of all records of a block of whole frames; a frame that doesn't fit its checksums raises ValueError."""
    at, lengths, data, sums = 0, [], [], []
    while at < len(block):
        if at + FRAME > len(block):
            raise ValueError(f"{where}: a frame is cut")
        n, a = _HEAD.unpack_from(block, at)
        end = at + FRAME + n
        if end > len(block):
            raise ValueError(f"{where}: a record is cut, or its length is damaged")
        lengths.append(block[at : at + 8])
        data.append(block[at + 12 : end - 4])
        sums.append((a, *struct.unpack_from("<I", block, end - 4)))
        at = end
    found = np.stack([masked(crc32c(lengths)), masked(crc32c(data))], axis=1) if data else np.empty((0, 2), np.uint32)
    if not np.array_equal(found, np.array(sums, np.uint32).reshape(-1, 2)):
        raise ValueError(f"{where}: a checksum doesn't match")
    return data


# ---------------------------------------------------------------- ids

_encoders: dict[str, Encoder] = {}

#: The columnar way takes the characters below: among them neither composition nor context changes anything, so
#: lower-casing and classes are the vocabulary's own. Left out are separators, one letter whose lower case has a mark of
#: its own, and what may begin a special token.
_TOP = 0x180
_LEFT_OUT = "\x1c\x1d\x1e\x1f\x85\xa0\u0130"
#: Fixed values of the vocabulary's rule for words; beside them letters, single digits and runs of other marks are words.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _characters(kind: str) -> str:
    return "".join(c for c in map(chr, range(_TOP)) if unicodedata.category(c)[0] == kind)


_LETTERS, _DIGITS = _characters("L"), _characters("N")
_WORD = f"({'|'.join(_CONTRACTIONS)}|[{_LETTERS}]+|[{_DIGITS}]|[^ {_LETTERS}{_DIGITS}]+)"
_OTHER = f"[^\\x00-\\x{{{_TOP - 1:x}}}]|[{_LEFT_OUT}]|<[|]"
_SPACES = re.compile("[ \\t-\\r]")
#: Byte-level vocabularies write each byte as one character: printable ones of Latin-1 stand for themselves, the others
#: for those from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4")))


def _nested(inner: pa.ListArray, at: np.ndarray) -> pa.ListArray:
    """Neighbouring lists joined: from at[i] to at[i + 1] each."""
    return pa.ListArray.from_arrays(pa.array(inner.offsets.to_numpy()[at]), inner.values)


class Encoder:
    """The ids of whole texts by a vocabulary file of the tokenizers library, as little-endian 32-bit words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge, self.known = self.library.model.tokenize, {"": b""}

    def new_word(self, word: str) -> bytes:
        signs = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_SIGNS)
        packed = b"".join([t.id.to_bytes(4, "little") for t in self.merge(signs)])
        if len(word) <= MAX_LENGTH:
            if len(self.known) >= MAX_KNOWN:
                self.known = {"": b""}
            self.known[word] = packed
        return packed

    def of_words(self, words: pa.Array) -> pa.ListArray:
        known = self.known.get
        return _lists([p if (p := known(w)) is not None else self.new_word(w) for w in words.to_pylist()])

    def of_stretches(self, stretches: pa.Array) -> pa.ListArray:
        other = pc.match_substring_regex(stretches, _OTHER)
        marked = pc.replace_substring_regex(pc.utf8_lower(stretches.filter(pc.invert(other))), _WORD, "\\1 ")
        words = pc.split_pattern(marked, " ")
        each = words.values.dictionary_encode()
        plain = _nested(self.of_words(each.dictionary).take(each.indices), words.offsets.to_numpy())
        if not other.true_count:
            return plain
        whole = self.library.encode_batch(stretches.filter(other).to_pylist(), add_special_tokens=False)
        both = pa.concat_arrays([plain, _lists([np.array(e.ids, "<u4").tobytes() for e in whole])])
        mask = other.to_numpy(zero_copy_only=False)
        return both.take(pa.array(np.where(mask, len(plain) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)))

    def of_texts(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        each = split.values.dictionary_encode()
        ids = _nested(self.of_stretches(each.dictionary).take(each.indices), split.offsets.to_numpy())
        packed, at = memoryview(ids.values.to_numpy()).cast("B"), (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
        return [bytes(packed[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, CHUNK characters at a time; a longer one goes in parts that end at white space."""
        out, held, size = [], [], 0

        def flush() -> None:
            nonlocal size
            for k, packed in zip([k for k, _ in held], self.of_texts([t for _, t in held]), strict=True):
                out[k].append(packed)
            held.clear()
            size = 0

        for k, text in enumerate(texts):
            out.append([])
            at = 0
            while at < len(text):
                gap = _SPACES.search(text, at + CHUNK) if len(text) - at > CHUNK else None
                end = gap.start() if gap else len(text)
                held.append((k, text[at:end]))
                size += end - at
                at = end
                if size >= CHUNK:
                    flush()
        flush()
        return [b"".join(parts) for parts in out]


def ready(path: str) -> Encoder:
    """The encoder of a vocabulary; a worker process keeps it, with the words it knows, for later tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- writing

_FILE_DDL = "path string, records long, tokens long, bytes long"
_FILE = pa.schema([("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bounded(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a larger row is a range of its own or ends one."""
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist(), 1):
        held += n
        if held >= most:
            yield first, i
            first, held = i, 0
    if first < len(sizes):
        yield first, len(sizes)


def write_records(docs: DataFrame, where: str, vocabulary: str, end_id: int | None = 1) -> DataFrame:
    """Writes docs (doc_id, text) below `where`, in the order of doc_id over all files, end_id after each document.
    Returns a row per file, in no order: path, records, tokens, bytes. `vocabulary` is a path that every executor has."""
    make_dir(docs.sparkSession, where)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(where)
        encoder, out, index, tokens, records = ready(vocabulary), None, None, 0, 0
        for b in batches:
            if out is None:
                name = f"{folder}/part-{TaskContext.get().partitionId():06d}.rec"
                out, index = Placed(fs, name), Placed(fs, name + ".idx")
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for first, last in _bounded(pc.binary_length(texts).fill_null(0).to_numpy(), SPAN):
                packed = encoder.encode([t or "" for t in texts.slice(first, last - first).to_pylist()])
                packed = [p + end for p in packed]
                data = [serialized(i, np.frombuffer(p, "<u4")) for i, p in zip(ids[first:last], packed, strict=True)]
                entries = np.empty(len(data), _ENTRY)
                entries["tokens"] = n = np.array([len(p) // 4 for p in packed])
                entries["before"] = tokens + np.cumsum(n) - n
                sizes = np.array([len(x) + FRAME for x in data])
                entries["at"] = out.size + np.cumsum(sizes) - sizes
                index.write(entries.tobytes())
                for x in frames(data):
                    out.write(x)
                tokens, records = tokens + int(n.sum()), records + len(n)
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"path": out.path, "records": records, "tokens": tokens, "bytes": out.size}], _FILE)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(_tasks(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return ordered.select("doc_id", "text").mapInArrow(run, _FILE_DDL)


# ---------------------------------------------------------------- reading

_SPAN_DDL = "path string, first long, at long, bytes long, records long, tokens_before long"
_SPAN = pa.schema([("path", pa.string())] + [(n, pa.int64()) for n in ("first", "at", "bytes", "records", "tokens_before")])


def spans(files: DataFrame, span: int = SPAN) -> DataFrame:
    """Spans of neighbouring records, by the indexes of `files` (path, bytes): path, first (the number of its first
    record within the file), at, bytes, records, tokens_before (in the file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, inner = store(path)
                made, open_, n = [], None, 0  # open_: the span that grows
                with fs.open_input_stream(inner + ".idx") as f:
                    while part := f.read(_ENTRY.itemsize << 16):
                        for at, before, _ in np.frombuffer(part, _ENTRY).tolist():
                            if open_ is None or at - open_[2] >= span:
                                if open_ is not None:
                                    made.append((*open_[:3], at - open_[2], n - open_[1], open_[3]))
                                open_ = (path, n, at, before)
                            n += 1
                if open_ is not None:
                    made.append((*open_[:3], size - open_[2], n - open_[1], open_[3]))
                yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(_SPAN)], schema=_SPAN)

    return files.select("path", "bytes").repartition(_tasks(files)).mapInArrow(run, _SPAN_DDL)


_RECORD_DDL = "path string, record long, doc_id long, tokens_before long, n_tokens long, ids_crc32 long"


def read_records(wanted: DataFrame, seed: int | None = None, ids: bool = False) -> DataFrame:
    """The records of `wanted` spans, each checked against its frame: path, record (its number within the file), doc_id,
    tokens_before (in the file), n_tokens, ids_crc32 (of its ids as they lie), and ids array<long> if asked for. With a
    seed, spans are dealt over the tasks, and taken within each, in an order drawn from it: a shuffled read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, at, size, _, before in zip(*(b.column(f.name).to_pylist() for f in _SPAN), strict=True):
                fs, inner = store(path)
                with fs.open_input_file(inner) as f:
                    block = f.read_at(size, at)
                if len(block) != size:
                    raise ValueError(f"{path} at {at}: the file is cut")
                data = unframed(block, f"{path} at {at}")
                heads, tokens = zip(*map(parsed, data), strict=True)
                n = np.array([len(x) // 4 for x in tokens], np.int64)
                columns = [
                    pa.array([path] * len(data), pa.string()), pa.array(np.arange(first, first + len(data))),
                    pa.array(heads, pa.int64()), pa.array(before + np.cumsum(n) - n), pa.array(n),
                    pa.array([zlib.crc32(x) for x in tokens], pa.int64()),
                ]
                names = ["path", "record", "doc_id", "tokens_before", "n_tokens", "ids_crc32"]
                if ids:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(tokens), "<u4").astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    wanted = wanted.withColumn("_draw", F.xxhash64("path", "at", F.lit(seed or 0)))
    dealt = wanted.repartition(_tasks(wanted), "_draw").sortWithinPartitions("_draw" if seed is not None else "at").drop("_draw")
    return dealt.mapInArrow(run, _RECORD_DDL + ", ids array<long>" * ids)


def tokens_before(files: DataFrame) -> DataFrame:
    """path, start: the tokens of all files before each. One small row per file takes part."""
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("start"))


def record_round_trip(docs: DataFrame, vocabulary: str, end_id: int | None = 1, seed: int = 0) -> DataFrame:
    """docs written and read back in shuffled order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    where = scratch_path(docs.sparkSession, "records")
    files = table(write_records(docs, where, vocabulary, end_id), "files")
    found = read_records(spans(files), seed).join(tokens_before(files), "path")
    return found.select("doc_id", (F.col("start") + F.col("tokens_before")).alias("start"), "n_tokens", "ids_crc32")


def record_files(spark: SparkSession, where: str) -> DataFrame:
    """path and bytes of the record files below a folder, for spans()."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(where)
    return found.select("path", F.col("length").alias("bytes"))
