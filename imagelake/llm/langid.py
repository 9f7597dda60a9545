"""Language identification by error-correcting output codes.

Each language has a binary codeword: all distinct splits of the languages for up to seven of them, random codes
with the largest minimum distance found for more. One logistic classifier over hashed byte n-grams is fitted per
bit. A text's margins are decoded by loss: each bit costs log(1 + exp(-margin)) where the codeword disagrees,
weighted by how well its classifier did in training; the nearest codeword is the language, and a text whose two
nearest codewords are almost as near is flagged ambiguous.

Fitting uses a bounded sample: at most `rows_per_language` texts of each language, those with the smallest
hashes of doc_id, and `max_rows` in all; their counts, not their texts, come to the driver. Everything else covers whole texts.

Defined results: a text that is null or has no letter is `und` with score 0; rows with a null lang or doc_id are
not learned from; without any row to learn from all is `und`; with one language only, every text with a letter
is of it; equal rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imagelake.llm.common import row_bytes, table

UNKNOWN = "und"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CHUNK = 1 << 19


@dataclass(frozen=True)
class Features:
    bits: int = 12
    orders: tuple[int, ...] = (1, 2, 3)

    def of(self, text: bytes) -> np.ndarray:
        """Root of the shares of hashed n-grams of bytes, ASCII letters lower-cased and other ASCII as space."""
        size = 1 << self.bits
        total = np.zeros(size, np.int64)
        last = max(self.orders) - 1
        for at in range(0, max(1, len(text)), _CHUNK):
            a = np.frombuffer(text[max(0, at - last) : at + _CHUNK].translate(_FOLD), np.uint8).astype(np.uint32)
            for n in self.orders:
                first = max(0, min(at, last) - (n - 1))  # n-grams that end in this part
                code = a[first : len(a) - n + 1]
                if len(a) - n + 1 <= first:
                    continue
                for i in range(1, n):
                    code = code << np.uint32(8) | a[first + i : len(a) - n + 1 + i]
                slot = ((code ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)
                total += np.bincount(slot, minlength=size)
        n = total.sum()
        return np.sqrt(total / n).astype(np.float32) if n else total.astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each language."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 7:
        columns = range(1, 1 << (languages - 1))
        return np.array([[1.0 if i == 0 or not c >> (i - 1) & 1 else -1.0 for c in columns] for i in range(languages)])
    rng, best, most = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2 + bits * np.eye(languages)
        if apart.min() > most and (np.abs(code.sum(0)) < languages).all():
            best, most = code, apart.min()
    return best


@dataclass
class Classifier:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 200, penalty: float = 1e-4) -> Classifier:
        """Logistic regressions, one per bit, by accelerated gradient steps; languages weigh the same."""
        code = codewords(len(languages))
        target = code[y]
        share = 1.0 / (np.bincount(y, minlength=len(languages))[y] * len(languages))
        w = np.zeros((x.shape[1], code.shape[1]), np.float32)
        b = np.zeros(code.shape[1], np.float32)
        vw, vb, rate = w.copy(), b.copy(), 3.0
        for t in range(steps if len(languages) > 1 else 0):
            m = target * (x @ vw + vb)
            g = (-target / (1 + np.exp(np.minimum(m, 50))) * share[:, None]).astype(np.float32)
            nw, nb = vw - rate * (x.T @ g + penalty * vw), vb - rate * g.sum(0)
            k = t / (t + 3)
            vw, vb = nw + k * (nw - w), nb + k * (nb - b)
            w, b = nw, nb
        right = ((target * (x @ w + b) > 0) * share[:, None]).sum(0) if len(y) else np.ones(code.shape[1])
        return Classifier(languages, code, w, b, np.maximum(2 * right - 1, 0.05))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: the nearest language's place, its score, and the gap to the next one's loss."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        margins = x @ self.weights + self.bias
        trust = self.trust / self.trust.sum()
        loss = (np.logaddexp(0, -margins) * trust) @ (self.code.T > 0) + (np.logaddexp(0, margins) * trust) @ (self.code.T < 0)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(x))
        best, second = loss[rows, order[:, 0]], loss[rows, order[:, 1]]
        odds = np.exp(-(loss - best[:, None]) * self.code.shape[1])
        return order[:, 0], 1 / odds.sum(1), second - best


def train(labelled: DataFrame, rows_per_language: int = 600, features: Features = Features(), max_rows: int = 12_000) -> Classifier | None:
    """labelled: doc_id, text, lang (none null). At most max_rows feature counts come to the driver, in one job, however
    many languages there are: with more than max_rows / rows_per_language of them each has fewer rows."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    each = max(1, min(rows_per_language, max_rows // len(counts)))
    scale = 1 << 40
    # The languages' shares as an expression: texts are filtered where they are read and don't move for a join.
    shares = [x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 1.1 * each / n) * scale)))]
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(scale))
    sample = labelled.filter(chance < F.try_element_at(F.create_map(*shares), "lang")).select("lang", chance.alias("chance"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features.of(t).astype(np.float16).tobytes() for t in row_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["lang", "chance", "x"])

    rows = table(sample.mapInArrow(run, "lang string, chance long, x binary"), "sample")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "x"))  # over some more than `each` rows
    got = rows.withColumn("nth", nth).filter(F.col("nth") <= each).select("lang", "nth", "x").collect()
    got.sort(key=lambda r: (r["lang"], r["nth"]))
    languages = sorted(counts)
    place = {name: i for i, name in enumerate(languages)}
    x = np.array([np.frombuffer(r["x"], np.float16) for r in got], np.float32)
    return Classifier.fit(x, np.array([place[r["lang"]] for r in got]), languages)


def identify(docs: DataFrame, model: Classifier | None, carry: tuple[str, ...] = ("doc_id",), ambiguous_gap: float = 0.05, features: Features = Features()) -> DataFrame:
    """The columns in `carry`, lang_pred, score (0 to 1) and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.num_rows
            names, scores, unsure = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            texts = b.column("_text")
            for at in range(0, n if m else 0, 512):
                known = [i for i, t in enumerate(texts.slice(at, 512).to_pylist(), at) if t and has_letter(t)]
                if not known:
                    continue
                x = np.array([features.of(t) for t in row_bytes(texts.take(pa.array(known)))])
                which, score, gap = m.decode(x)
                for i, w in zip(known, which, strict=True):
                    names[i] = m.languages[w]
                scores[known], unsure[known] = score, gap < ambiguous_gap
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(names), pa.array(scores), pa.array(unsure)], [*carry, "lang_pred", "score", "ambiguous"])

    source = docs.select(*carry, F.col("text").alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}, lang_pred string, score double, ambiguous boolean")


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id's decimal text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def language_id(docs: DataFrame, rows_per_language: int = 600) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, ambiguous; learned from rows not held out."""
    labelled = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    model = train(labelled.select("doc_id", "text", "lang"), rows_per_language)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ("doc_id", "held_out"))
