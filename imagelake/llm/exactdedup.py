"""Exact dedup by a log-structured merge index.

1. Memtables. Each task digests its documents (SHA-256 of the text with A-Z lower-cased) into a memtable of
   bounded rows and bytes. A full one is flushed as a run: a file with the new texts, compressed one by one, and
   behind them their digests in order with the texts' places; the task keeps the run's filter and every 256th
   digest. A text that the memtable doesn't hold is looked up in the task's runs whose filter lets its digest
   pass. A hit, in the memtable or a run, is verified against the stored bytes. So a task has one entry per
   distinct text, however many copies come, and its memory grows with filters only.
2. Compaction. The entries of all runs are merged in the order of their digests, a range of digests per task. Of
   entries with one digest the first leads, and each other one is verified against it: a task reads both texts
   from the runs at their places, so no text is shuffled, and compares the bytes. Entries whose bytes differ
   (a collision) are merged again among themselves. Entries of equal texts are a group; the smallest identifier
   of a group stays.
3. Answers. Each document finds its entry, and through it the entry's group. An entry belongs to one task, so no
   key gathers more rows than a task holds.

The identifier that compaction keeps smallest is doc_id for keep="first" and its complement for keep="last".

Defined results: a null text equals an empty one; a null doc_id comes after every other, so it stays only
where no member has an id; of rows that repeat both text and doc_id one stays; an empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.common import make_dir, row_bytes, scratch_path, table
from imagelake.llm.files import Placed, store

_ROW = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("sha", pa.binary()), ("seq", pa.int64()), ("entry", pa.int64()), ("lead", pa.bool_()),
     ("ord", pa.int64()), ("n", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_ROW_DDL = "doc_id long, text_key long, sha binary, seq long, entry long, lead boolean, ord long, n long, path string, offset long, length long"
_FENCE = 256
#: Bytes of texts that a verifying task keeps at hand.
_CACHE = 32 << 20


class Filter:
    """Which digests a run may hold: 16 bits an entry, two probes; sized by the run."""

    def __init__(self, digests: list[bytes]):
        self.mask = (1 << max(6, (16 * len(digests) - 1).bit_length())) - 1
        self.bits = np.zeros((self.mask + 1) // 8, np.uint8)
        for d in digests:
            for p in self.probes(d):
                self.bits[p >> 3] |= 1 << (p & 7)

    def probes(self, digest: bytes) -> tuple[int, int]:
        x = int.from_bytes(digest[:8], "big")
        return x & self.mask, (x * 0x9E3779B97F4A7C15 >> 32) & self.mask

    def passes(self, digest: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.probes(digest))


class Run:
    """A flushed memtable: texts, then (digest, offset, length, entry) in order of the digests."""

    def __init__(self, fs, folder: str, digest_bytes: int, texts: list[tuple[bytes, bytes, int]]):
        """texts: (digest, text, entry) in order of the digests."""
        out = Placed(fs, f"{folder}/{uuid.uuid4().hex}.run")
        self.fs, self.path, self.digest_bytes, self.file = fs, out.path, digest_bytes, None
        self.width, self.size, self.places = digest_bytes + 24, len(texts), []
        pack, index = zstandard.ZstdCompressor(level=1), []
        for digest, text, entry in texts:
            packed = pack.compress(text)
            self.places.append((out.size, len(packed)))
            index.append(digest + np.array([out.size, len(packed), entry], "<i8").tobytes())
            out.write(packed)
        self.start = out.size
        out.write(b"".join(index))
        out.close()
        self.fences = [t[0] for t in texts[::_FENCE]]
        self.filter = Filter([t[0] for t in texts])

    def find(self, digest: bytes) -> Iterator[tuple[int, bytes]]:
        """(entry, text) of the entries with a digest."""
        if not self.filter.passes(digest):
            return
        if self.file is None:
            self.file = self.fs.open_input_file(self.path)
        first = max(0, bisect_right(self.fences, digest) - 1)
        while first > 0 and self.fences[first] == digest:  # equal digests may begin in the block before
            first -= 1
        for at in range(first * _FENCE, self.size, _FENCE):
            self.file.seek(self.start + at * self.width)
            block = self.file.read(self.width * min(_FENCE, self.size - at))
            for row in range(0, len(block), self.width):
                held = block[row : row + self.digest_bytes]
                if held > digest:
                    return
                if held == digest:
                    offset, length, entry = np.frombuffer(block, "<i8", 3, row + self.digest_bytes).tolist()
                    yield entry, read_text(self.file, offset, length)


def read_text(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return zstandard.decompress(file.read(length))


class Memtable:
    """Texts of one task until a flush, and the task's runs; rows are numbered within the task."""

    def __init__(self, task: int, where: str, last: bool, max_rows: int, max_bytes: int, digest_bytes: int):
        self.fs, self.folder = store(where)
        self.last, self.max_rows, self.max_bytes, self.digest_bytes = last, max_rows, max_bytes, digest_bytes
        self.next_row, self.runs = task << 40, []
        self.clear()

    def clear(self) -> None:
        self.held, self.rows, self.bytes = {}, 0, 0

    def add(self, doc_id: int | None, key: int, text: bytes) -> None:
        text = text.lower()  # bytes: A-Z only
        sha = hashlib.sha256(text).digest()
        digest = sha[: self.digest_bytes]
        known = self.held.setdefault(digest, [])
        for held in known:
            if held[0] == text:  # the bytes decide, not the digest
                held[2].append((doc_id, key))
                break
        else:
            entry = next((e for run in reversed(self.runs) for e, t in run.find(digest) if t == text), None)
            known.append((text, sha, [(doc_id, key)], entry))
            self.bytes += len(text)
        self.rows += 1

    def full(self) -> bool:
        return self.rows >= self.max_rows or self.bytes >= self.max_bytes

    def order_of(self, doc_id: int | None) -> int | None:
        return ~doc_id if self.last and doc_id is not None else doc_id

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows, fresh = [], []
        for digest in sorted(self.held):
            for text, sha, ids, entry in self.held[digest]:
                order = [self.order_of(i) for i, _ in ids]
                first = min(range(len(ids)), key=lambda i: (order[i] is None, order[i] or 0, i))
                new = entry is None
                if new:
                    entry = self.next_row + first
                    fresh.append((digest, text, entry))
                for i, (doc_id, key) in enumerate(ids):
                    place = len(fresh) - 1 if new and i == first else None
                    rows.append((doc_id, key, sha, self.next_row + i, entry, i == first, order[first], len(ids), place))
                self.next_row += len(ids)
        if fresh:
            self.runs.append(Run(self.fs, self.folder, self.digest_bytes, fresh))
        self.clear()
        for at in range(0, len(rows), 20_000):
            part = [(*r[:-1], None, None, None) if r[-1] is None else (*r[:-1], self.runs[-1].path, *self.runs[-1].places[r[-1]]) for r in rows[at : at + 20_000]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _ROW, strict=True)], schema=_ROW)


def indexed(docs: DataFrame, where: str, last: bool, max_rows: int, max_bytes: int, digest_bytes: int) -> DataFrame:
    """One row per document. `lead` marks, per flush and entry, the row with the smallest identifier; ord and n are that
    identifier and the flush's rows of the entry. The lead of a new entry has the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable = Memtable(TaskContext.get().partitionId(), where, last, max_rows, max_bytes, digest_bytes)
        for b in batches:
            for doc_id, text, key in zip(b.column(0).to_pylist(), row_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                memtable.add(doc_id, key, text or b"")
                if memtable.full():
                    yield from memtable.flush()
        yield from memtable.flush()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, _ROW_DDL)


_PLACE = ("digest", "entry", "path", "offset", "length")
_PAIR_DDL = "digest binary, entry long, path string, offset long, length long, to_entry long, to_path string, to_offset long, to_length long"


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def merged(entries: DataFrame) -> DataFrame:
    """Entries in order of their digests, a range of digests per task: those that don't lead their digest, each with the
    one that does. Streams; a digest has at most one entry per task that made runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for b in batches:
            found, to = [], []
            for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if lead is None or row[0] != lead[0]:
                    lead = row
                else:
                    found.append(i)
                    to.append(lead[1:])
            rest = [pa.array([t[k] for t in to], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            rows = b.take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *rest], [*_PLACE, *(f"to_{c}" for c in _PLACE[1:])])

    # Digests are spread evenly, so the ranges are known: their leading 32 bits, cut into as many parts as there are tasks.
    n = _tasks(entries)
    leading = F.conv(F.rpad(F.hex(F.expr("substring(digest, 1, 4)")), 8, "0"), 16, 10).cast("long")
    ranges = entries.select(*_PLACE).repartitionById(n, F.shiftright(leading * n, 32).cast("int"))
    return ranges.sortWithinPartitions("digest", "entry").mapInArrow(run, _PAIR_DDL)


def verified(pairs: DataFrame) -> DataFrame:
    """pairs with `same`: whether the bytes of both texts are equal, read from the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, texts, held = OrderedDict(), OrderedDict(), 0

        def read(path: str, offset: int, length: int) -> bytes:
            if path not in files:
                if len(files) >= 16:
                    files.popitem(last=False)[1].close()
                fs, inner = store(path)
                files[path] = fs.open_input_file(inner)
            files.move_to_end(path)
            return read_text(files[path], offset, length)

        for b in batches:
            same = []
            for path, offset, length, to_path, to_offset, to_length in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 6, 7, 8)), strict=True):
                lead = texts.get((to_path, to_offset))
                if lead is None:
                    lead = texts[to_path, to_offset] = read(to_path, to_offset, to_length)
                    held += len(lead)
                    while held > _CACHE:
                        held -= len(texts.popitem(last=False)[1])
                same.append(read(path, offset, length) == lead)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same, pa.bool_())], [*b.schema.names, "same"])
        for f in files.values():
            f.close()

    # What one task has indexed is verified by one task, which reads its runs from front to back.
    dealt = pairs.repartitionById(_tasks(pairs), F.shiftright("entry", 40).cast("int")).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, f"{_PAIR_DDL}, same boolean")


def exact_dedup(
    docs: DataFrame, keep: str = "last", max_rows: int = 20_000, max_bytes: int = 32 << 20, digest_bytes: int = 32
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (of the row that stays), group_size, kept,
    text_sha256, and text_key, a hash of the text as it is.

    max_rows, max_bytes: what a memtable holds before it is flushed. digest_bytes: of the index key; shorter
    ones collide, which costs time but changes no result.
    """
    last = {"first": False, "last": True}[keep]
    where = scratch_path(docs.sparkSession, "runs")
    make_dir(docs.sparkSession, where)
    rows = table(indexed(docs, where, last, max_rows, max_bytes, digest_bytes), "index")
    leads = rows.filter("lead")
    rest, groups = leads.filter("path is not null").withColumn("digest", F.expr(f"substring(sha, 1, {digest_bytes})")), None
    while True:  # a second time only if digests of different texts are equal
        checked = table(verified(table(merged(rest), "contested")), "checked")
        equal = checked.filter("same").select("entry", F.col("to_entry").alias("grp"))
        groups = equal if groups is None else groups.union(equal)
        rest = checked.filter("not same")
        if not rest.head(1):
            break
    # Entries that stand for more than one flush or run; all others answer for themselves.
    grp = F.coalesce("grp", "entry").alias("grp")
    several = leads.filter("entry != seq").select("entry").union(groups.select("entry")).union(groups.select(F.col("grp").alias("entry"))).distinct()
    several = table(several.join(groups, "entry", "left").select("entry", grp), "several")
    best = F.min(F.struct(F.col("ord").isNull().alias("missing"), "ord", "seq")).alias("best")
    figures = leads.select("entry", "ord", "seq", "n").join(several, "entry").groupBy("grp").agg(best, F.sum("n").alias("size"))
    answers = table(several.join(figures, "grp").select("entry", F.col("best.ord").alias("best"), F.col("best.seq").alias("best_seq"), "size"), "answers")
    out = rows.drop("path", "offset", "length").join(answers, "entry", "left")
    order = F.when(F.col("size").isNull(), F.col("ord")).otherwise(F.col("best"))
    return out.select(
        "doc_id",
        (F.bitwise_not(order) if last else order).alias("keep_id"),
        F.coalesce("size", "n").alias("group_size"),
        (F.col("lead") & (F.coalesce("best_seq", "seq") == F.col("seq"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "text_key",
    )
