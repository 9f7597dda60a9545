"""Mutants of files, for decoders to be tried on. The same seed gives the same mutants wherever they are made."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flip(data: bytearray, rng: random.Random) -> None:
    data[rng.randrange(len(data))] ^= 1 << rng.randrange(8)


def put(data: bytearray, rng: random.Random) -> None:
    data[rng.randrange(len(data))] = rng.randrange(256)


def remove(data: bytearray, rng: random.Random) -> None:
    at = rng.randrange(len(data))
    del data[at : at + rng.randint(1, 32)]


def insert(data: bytearray, rng: random.Random) -> None:
    data.insert(rng.randint(0, len(data)), rng.randrange(256))


def cut(data: bytearray, rng: random.Random) -> None:
    del data[rng.randrange(len(data)) :]


CHANGES = (flip, put, remove, insert, cut)


def mutate(data: bytes, seed: str) -> bytes:
    """One to eight changes; what is left empty stays empty."""
    rng, out = random.Random(seed), bytearray(data)
    for _ in range(rng.randint(1, 8)):
        change = rng.choice(CHANGES)
        if out:
            change(out, rng)
    return bytes(out)


def mutants(files: DataFrame, key: str, each: int, seed: int = 0, content: str = "content") -> DataFrame:
    """(key, mutant, content): `each` mutants of every file. Null contents stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                made = [None if data is None else mutate(data, f"{seed}:{name}:{k}") for k in range(each)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * each, b.schema.field(0).type), pa.array(range(each), pa.int32()), pa.array(made, pa.binary())], [key, "mutant", "content"])

    return files.select(key, F.col(content).alias("content")).mapInArrow(run, f"`{key}` {dict(files.dtypes)[key]}, mutant int, content binary")
