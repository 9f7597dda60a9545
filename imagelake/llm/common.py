"""Helpers shared by the operators: shared scratch tables, bounded id filters, byte-level words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose executors run
    on the driver's machine gets one of its own; any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="imagelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def make_dir(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.mkdirs(where)


def _clean() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have gone first
            return


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write df below the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    remove(df.sparkSession, df.scratch_path)


def spread_join(rows: DataFrame, key: str, by: str, partial: list[Column], whole: list[Column], salts: int = 32) -> DataFrame:
    """rows with figures of their key: `partial` aggregates over rows, `whole` over those. Rows of one key are dealt
    over `salts` tasks by the column `by`, and its figures go to each of these, so a key may hold a third of all
    rows; keys with few rows are repeated no more often than they have rows. Figures replace columns of their names."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    figures = salted.groupBy(key, "_salt").agg(*partial).groupBy(key).agg(*whole, F.collect_set("_salt").alias("_salts"))
    names = [c for c in figures.columns if c not in (key, "_salts")]
    spread = figures.select(key, *names, F.explode("_salts").alias("_salt"))
    return salted.drop(*names).join(table(spread, "spread"), [key, "_salt"]).drop("_salt")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; pure ASCII takes the byte-wise path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_bytes(array: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column of an Arrow batch."""
    return array.cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary()).to_pylist()


def released(run):
    """run (of mapInArrow), which gives freed memory back when it is done: worker processes live on, and their allocators
    would keep it for batches to come."""

    def over(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return over


# ---------------------------------------------------------------- bounded filters

#: Bits of an id filter: 2^26 bits are 8 MB on the driver and in each worker, at any input size.
FILTER_BITS = 26


def filter_slot(*cols: Column, bits: int = FILTER_BITS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << bits))


def build_filter(slots: DataFrame, bits: int = FILTER_BITS) -> bytes:
    """A bitmap with one hash of every row of `slots` (one column, filter_slot). Its size is fixed, so it
    can be broadcast at any input size: a full one lets more rows pass, never fewer."""
    c = F.col(slots.columns[0]) + 1  # the bitmap functions count from 1
    parts = (
        slots.groupBy(F.bitmap_bucket_number(c).alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("m"))
        .collect()
    )  # at most 2^bits / 32768 rows of 4 kB
    whole = bytearray((1 << bits) // 8 + 4096)
    for r in parts:
        at = (r["b"] - 1) * 4096
        whole[at : at + 4096] = bytes(r["m"])
    return bytes(whole)


def in_filter(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- words as bytes

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        size = max(n, _CHUNK // 8)
        for base in (_P, _PINV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _pow.append(np.multiply.accumulate(x))
        del _pow[:-2]
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sp = _IS_SPACE[a]
    edges = np.flatnonzero(sp[1:] != sp[:-1]) + 1
    if not sp[0]:
        edges = np.concatenate(([0], edges))
    if not sp[-1]:
        edges = np.concatenate((edges, [len(a)]))
    return edges[0::2], edges[1::2]


def _piece_hashes(a: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(a)
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers(len(a))
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _P)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; memory beyond the text is bounded by the chunk or the longest word."""
    a = np.frombuffer(text, np.uint8)
    if len(a) <= _CHUNK:
        return _piece_hashes(a)
    out, at = [], 0
    while at < len(a):
        end = min(len(a), at + _CHUNK)
        while end < len(a) and not _IS_SPACE[a[end - 1]]:
            gap = np.flatnonzero(_IS_SPACE[a[end : end + _CHUNK]])
            end = end + int(gap[0]) + 1 if len(gap) else min(len(a), end + _CHUNK)
        out.append(_piece_hashes(a[at:end]))
        at = end
    return np.concatenate(out)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n words; of a shorter text, one of all its words; none without words."""
    k = len(words)
    if not k:
        return words
    width = min(n, k)
    out = np.full(k - width + 1, np.uint64(width))
    for i in range(width):
        out = (out ^ words[i : k - width + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)
