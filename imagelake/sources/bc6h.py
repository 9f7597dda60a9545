"""BC6H blocks, decoding only: fourteen modes of half-float colours, one or two subsets, plain or delta endpoints.

The layouts are those of the Khronos Data Format Specification, chapter on BPTC compressed formats."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.sources.bc7 import ANCHORS, SUBSETS, WEIGHTS, Words

# Of each mode number: bits of the first endpoint, bits of the others (red, green, blue), whether they are
# deltas, and the fields behind the mode number, lowest bit of the block first. A field is a colour (r, g, b) with an
# endpoint (w, x, y, z) and its bits: one, or from the highest to the lowest; those from a low to a high number stand in
# reverse. d is the partition.
MODES = {
    0: (10, (5, 5, 5), True, "gy4 by4 bz4 rw9-0 gw9-0 bw9-0 rx4-0 gz4 gy3-0 gx4-0 bz0 gz3-0 bx4-0 bz1 by3-0 ry4-0 bz2 rz4-0 bz3 d4-0"),
    1: (7, (6, 6, 6), True, "gy5 gz4 gz5 rw6-0 bz0 bz1 by4 gw6-0 by5 bz2 gy4 bw6-0 bz3 bz5 bz4 rx5-0 gy3-0 gx5-0 gz3-0 bx5-0 by3-0 ry5-0 rz5-0 d4-0"),
    2: (11, (5, 4, 4), True, "rw9-0 gw9-0 bw9-0 rx4-0 rw10 gy3-0 gx3-0 gw10 bz0 gz3-0 bx3-0 bw10 bz1 by3-0 ry4-0 bz2 rz4-0 bz3 d4-0"),
    6: (11, (4, 5, 4), True, "rw9-0 gw9-0 bw9-0 rx3-0 rw10 gz4 gy3-0 gx4-0 gw10 gz3-0 bx3-0 bw10 bz1 by3-0 ry3-0 bz0 bz2 rz3-0 gy4 bz3 d4-0"),
    10: (11, (4, 4, 5), True, "rw9-0 gw9-0 bw9-0 rx3-0 rw10 by4 gy3-0 gx3-0 gw10 bz0 gz3-0 bx4-0 bw10 by3-0 ry3-0 bz1 bz2 rz3-0 bz4 bz3 d4-0"),
    14: (9, (5, 5, 5), True, "rw8-0 by4 gw8-0 gy4 bw8-0 bz4 rx4-0 gz4 gy3-0 gx4-0 bz0 gz3-0 bx4-0 bz1 by3-0 ry4-0 bz2 rz4-0 bz3 d4-0"),
    18: (8, (6, 5, 5), True, "rw7-0 gz4 by4 gw7-0 bz2 gy4 bw7-0 bz3 bz4 rx5-0 gy3-0 gx4-0 bz0 gz3-0 bx4-0 bz1 by3-0 ry5-0 rz5-0 d4-0"),
    22: (8, (5, 6, 5), True, "rw7-0 bz0 by4 gw7-0 gy5 gy4 bw7-0 gz5 bz4 rx4-0 gz4 gy3-0 gx5-0 gz3-0 bx4-0 bz1 by3-0 ry4-0 bz2 rz4-0 bz3 d4-0"),
    26: (8, (5, 5, 6), True, "rw7-0 bz1 by4 gw7-0 by5 gy4 bw7-0 bz5 bz4 rx4-0 gz4 gy3-0 gx4-0 bz0 gz3-0 bx5-0 by3-0 ry4-0 bz2 rz4-0 bz3 d4-0"),
    30: (6, (6, 6, 6), False, "rw5-0 gz4 bz0 bz1 by4 gw5-0 gy5 by5 bz2 gy4 bw5-0 gz5 bz3 bz5 bz4 rx5-0 gy3-0 gx5-0 gz3-0 bx5-0 by3-0 ry5-0 rz5-0 d4-0"),
    3: (10, (10, 10, 10), False, "rw9-0 gw9-0 bw9-0 rx9-0 gx9-0 bx9-0"),
    7: (11, (9, 9, 9), True, "rw9-0 gw9-0 bw9-0 rx8-0 rw10 gx8-0 gw10 bx8-0 bw10"),
    11: (12, (8, 8, 8), True, "rw9-0 gw9-0 bw9-0 rx7-0 rw10-11 gx7-0 gw10-11 bx7-0 bw10-11"),
    15: (16, (4, 4, 4), True, "rw9-0 gw9-0 bw9-0 rx3-0 rw10-15 gx3-0 gw10-15 bx3-0 bw10-15"),
}


def _bits(text: str) -> list[tuple[str, int]]:
    """(field, bit) of each bit of the layout, in the order of the block."""
    out = []
    for name, a, b in re.findall(r"([rgb][wxyz]|d)(\d+)(?:-(\d+))?", text):
        a, b = int(a), int(b or a)
        out += [(name, k) for k in (range(b, a + 1) if a >= b else range(b, a - 1, -1))]
    return out


LAYOUTS = {mode: _bits(text) for mode, (*_, text) in MODES.items()}


def _signed(v: np.ndarray, bits: int) -> np.ndarray:
    return v - ((v >> (bits - 1) & 1) << bits)


def _whole(v: np.ndarray, bits: int, signed: bool) -> np.ndarray:
    """Endpoints of so many bits on the scale of 16."""
    if bits >= (16 if signed else 15):
        return v
    if not signed:
        return np.where(v == 0, 0, np.where(v == (1 << bits) - 1, 0xFFFF, ((v << 16) + 0x8000) >> bits))
    m = np.abs(v)
    m = np.where(m >= (1 << (bits - 1)) - 1, 0x7FFF, ((m << 15) + 0x4000) >> (bits - 1))
    return np.where(v == 0, 0, np.where(v < 0, -m, m))


def _of_mode(mode: int, raw: np.ndarray, signed: bool) -> np.ndarray:
    first, others, delta, _ = MODES[mode]
    words, fields = Words(raw, 2 if mode < 2 else 5), {}
    for name, bit in LAYOUTS[mode]:
        fields[name] = fields.get(name, 0) | words.take(1) << bit
    n, subsets = len(raw), 2 if "d" in fields else 1
    partition = fields.get("d", np.zeros(n, np.int64))
    ends = np.empty((n, subsets, 2, 3), np.int64)
    for k, name in enumerate("wxyz"[: 2 * subsets]):
        for c, bits in enumerate(others):
            v = fields["rgb"[c] + name]
            if k and delta:
                v = fields["rgb"[c] + "w"] + _signed(v, bits) & (1 << first) - 1
            ends[:, k // 2, k % 2, c] = _whole(_signed(v, first) if signed else v, first, signed)
    size = 3 if subsets == 2 else 4
    w = np.array(WEIGHTS[size])[words.indices(size, ANCHORS[subsets][partition])][:, :, None]
    rows, subset = np.arange(n)[:, None], SUBSETS[subsets][partition]
    mixed = (ends[rows, subset, 0] * (64 - w) + ends[rows, subset, 1] * w + 32) >> 6
    if not signed:
        return mixed * 31 >> 6
    m = np.abs(mixed) * 31 >> 5
    return np.where((mixed < 0) & (m > 0), m | 0x8000, m)


def decoded(raw: bytes, blocks: int, signed: bool = False) -> np.ndarray:
    """(blocks, 16, RGB) of half-float words, all blocks of a mode at once; a reserved mode is black."""
    words = np.frombuffer(raw, "<u8", 2 * blocks).reshape(blocks, 2)
    low = (words[:, 0] & np.uint64(31)).astype(np.int64)
    number, out = np.where(low & 3 < 2, low & 3, low), np.zeros((blocks, 16, 3), np.uint16)
    for mode in MODES:
        own = np.flatnonzero(number == mode)
        if len(own):
            out[own] = _of_mode(mode, words[own], signed)
    return out


def decode_block(block: bytes, signed: bool) -> list[tuple[int, int, int]]:
    return [tuple(px) for px in decoded(block, 1, signed)[0].tolist()]


def decode(raw: bytes, blocks: int, signed: bool = False) -> np.ndarray:
    """(blocks, 16, RGB) of float16."""
    return decoded(raw, blocks, signed).view(np.float16)


def decode_words(elements: DataFrame, key: str, signed: bool = False) -> DataFrame:
    """(key, element) -> (key, y, x, red, green, blue): half-float words of each block's texels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            v = decode(b"".join(b.column(1).to_pylist()), n, signed).view(np.uint16).astype(np.int32).reshape(n * 16, 3)
            slot = np.tile(np.arange(16, dtype=np.int32), n)
            made = [pa.array(c) for c in (slot // 4, slot % 4, *v.T)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(n), 16))), *made], [key, "y", "x", "red", "green", "blue"])

    return elements.select(key, F.col("element")).mapInArrow(run, f"`{key}` {dict(elements.dtypes)[key]}, y int, x int, red int, green int, blue int")
