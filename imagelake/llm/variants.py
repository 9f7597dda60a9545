"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

One inserted, deleted or replaced code point leaves the first or the last half of the shorter word intact. So a word
of length L stands in four places: for partners of its length or one more by the first half and by the last half of
L, and for partners one shorter by those of L - 1. The forward dictionary is sorted by (length, first half), the
reversed one by (length, last half backwards); words that share a half are neighbours, and a scan over ranges of the
dictionaries meets them as one block. A block is what is known to be shared: a head and a tail. Where a block holds
more than `block` words its open middle is halved again, as one edit leaves one half of that intact too: its words
move to a block with a longer head and to one with a longer tail. Every round halves the middles, so the rounds are
few, and a block whose middle is empty or one code point wide has no more words than there are letters (or pairs of
them). Blocks of up to `block` words are split in the same way within their task until few words are left, and these
are compared. No pair is emitted that isn't verified; a word's pairs are bounded by its length times the alphabet.

Each word's form is its near word with the largest count, if that is large enough; forms of forms are followed by
doubling: counts grow by a factor each time, so 64-bit counts end after few rounds.

Defined results: a null or empty text has no words; a null doc_id reads as an empty string before the colon; repeated
rows count as often as they stand; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.llm.common import LOWER, UPPER, table

RUN = "[A-Za-zÀ-ÿ]+"
_RUNS = re.compile(RUN)
_LOWERED = str.maketrans(UPPER, LOWER)
#: Distinct words of a task that are counted before their counts are handed on.
MAX_COUNTED = 1 << 19
#: Words of a block that are compared with each other at once.
FEW = 12


def spelled_runs(doc_id: int | None, text: str, every: int) -> Counter:
    """The runs of a text, lower-cased, with their counts; a run whose checksum `every` divides loses a code point."""
    own = b"" if doc_id is None else b"%d" % doc_id
    start, out = zlib.crc32(own + b":"), Counter()
    for run, n in Counter(_RUNS.findall(text.translate(_LOWERED))).items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, every: int = 199) -> DataFrame:
    """word, n: the spelled runs of docs (doc_id, text) of at least min_chars code points and min_count occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                for word, n in spelled_runs(ids[i].as_py(), texts[i].as_py() or "", every).items():
                    if len(word) >= min_chars:
                        counts[word] += n
                if len(counts) >= MAX_COUNTED:
                    yield handed()
                    counts = Counter()
        yield handed()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---------------------------------------------------------------- blocks


def dictionaries(words: DataFrame, min_chars: int = 1) -> DataFrame:
    """A row per place of a word: len (of the shorter word of a pair), head and tail (code points known to be shared),
    backward (the reversed dictionary), key (what is shared), word, n."""
    places = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("len")).filter(F.col("len") >= min_chars)
    half = F.floor(F.col("len") / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(False).alias("backward"), half.alias("head"), F.lit(0).alias("tail")),
        F.struct(F.lit(True).alias("backward"), F.lit(0).alias("head"), (F.col("len") - half).alias("tail")),
    )
    return _keyed(places.select("*", F.explode(sides).alias("s")).select("word", "n", "len", "s.*"))


def _keyed(places: DataFrame) -> DataFrame:
    """key: the shared head, and the shared tail backwards, so that sorting by it sorts either dictionary."""
    tail = F.reverse(F.expr("right(word, tail)"))
    head = F.expr("left(word, head)")
    both = F.when(F.col("backward"), F.concat_ws("\u0001", tail, head)).otherwise(F.concat_ws("\u0001", head, tail))
    return places.withColumn("key", both)


BLOCK = ["len", "head", "tail", "backward", "key"]


def subdivided(places: DataFrame) -> DataFrame:
    """Each place twice, with half of its open middle added to the head, or the rest of it to the tail."""
    middle = F.col("len") - F.col("head") - F.col("tail")
    half = F.floor(middle / 2).cast("int")
    sides = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + middle - half).alias("tail")),
    )
    return _keyed(places.select("word", "n", "len", "backward", F.explode(sides).alias("s")).select("word", "n", "len", "backward", "s.*"))


def settled_blocks(words: DataFrame, block: int, min_chars: int = 1) -> list[DataFrame]:
    """Places whose blocks have at most `block` words, or an open middle of at most one code point: a table per round."""
    out, places = [], table(dictionaries(words, min_chars), "places")
    while True:
        large = places.filter("len - head - tail > 1").groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block)
        large = table(large.drop("size"), "large")
        if large.isEmpty():
            return [*out, places]
        out.append(table(places.join(large, BLOCK, "left_anti"), "settled"))
        places = table(subdivided(places.join(large, BLOCK, "left_semi")), "places")


def is_near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_pairs(words: list[str], length: int, head: int, tail: int) -> Iterator[tuple[int, int]]:
    """Places in `words` of pairs one edit apart; all are of `length` or one more, and share head and tail. A pair may
    come more than once."""
    work = [(list(range(len(words))), head, tail)]
    while work:
        own, head, tail = work.pop()
        middle = length - head - tail
        if len(own) > FEW and middle > 1:
            for more_head, more_tail in ((middle // 2, 0), (0, middle - middle // 2)):
                parts = defaultdict(list)
                for i in own:
                    w = words[i]
                    parts[w[head : head + more_head] if more_head else w[len(w) - tail - more_tail : len(w) - tail]].append(i)
                work += [(p, head + more_head, tail + more_tail) for p in parts.values() if len(p) > 1]
        else:
            for i in (i for i in own if len(words[i]) == length):
                for j in own:
                    if (j < i or len(words[j]) > length) and is_near(words[i], words[j]):
                        yield i, j


_PAIRS = "word string, near string, near_n long"


def scanned(places: DataFrame) -> DataFrame:
    """Both directions of each near pair (word, near, near_n), by a scan over ranges of the dictionaries; may repeat."""
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, words, counts, out = None, [], [], ([], [], [])

        def close() -> None:
            for i, j in near_pairs(words, *open_[:3]) if len(words) > 1 else ():
                for column, v in zip(out, ((words[i], words[j]), (words[j], words[i]), (counts[j], counts[i])), strict=True):
                    column.extend(v)

        def handed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for *block, word, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != open_:
                    close()
                    open_, words, counts = block, [], []
                    if len(out[0]) >= 10_000:
                        yield handed()
                words.append(word)
                counts.append(count)
        close()
        yield handed()

    # By ranges of what a block shares: blocks are bounded, and none is cut.
    ranged = places.select("len", "head", "tail", "backward", "key", "word", "n").repartitionByRange(n, "backward", "key", "len", "head", "tail")
    return ranged.sortWithinPartitions("backward", "key", "len", "head", "tail", "word").mapInArrow(run, _PAIRS)


def spelling_variants(words: DataFrame, factor: int = 5, block: int = 2048, min_chars: int = 1) -> DataFrame:
    """words (word, n; distinct) with form, form_n, root and n_near: the most frequent near word (ties: the smallest) if it
    has at least `factor` times the word's count, where forms of forms end, and the number of near words. No word may have
    fewer than min_chars code points."""
    words = table(words.select("word", "n"), "words")
    pairs = None
    for places in settled_blocks(words, block, min_chars):
        pairs = scanned(places) if pairs is None else pairs.union(scanned(places))
    pairs = table(pairs, "pairs").distinct()
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    has = -F.col("best.less") >= F.lit(factor) * F.col("n")
    known = table(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"),
        ), "forms",
    )
    steps = table(known.filter("form is not null").select("word", F.col("form").alias("to")), "steps")
    while True:
        onward = steps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        doubled = table(steps.join(onward, "to", "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "steps")
        if doubled.filter("moved").isEmpty():
            break
        steps = doubled.select("word", "to")
    return known.join(doubled.select("word", F.col("to").alias("root")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
