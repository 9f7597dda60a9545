"""PIZ compression: values ranked by a bitmap, a two-dimensional wavelet, and canonical Huffman codes with runs."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from imagelake.sources.base import FormatError

SYMBOLS = 65_537
SHORT_RUN, LONG_RUN, SHORTEST_LONG, LONGEST = 59, 63, 6, 261

# ---------------------------------------------------------------- wavelet


def _short(v: np.ndarray) -> np.ndarray:
    return ((v + 0x8000) & 0xFFFF) - 0x8000


def _enc(a, b, narrow: bool):
    if narrow:
        a, b = _short(a), _short(b)
        return (a + b >> 1) & 0xFFFF, (a - b) & 0xFFFF
    a = (a + 0x8000) & 0xFFFF
    m, d = a + b >> 1, a - b
    return np.where(d < 0, (m + 0x8000) & 0xFFFF, m), d & 0xFFFF


def _dec(low, high, narrow: bool):
    if narrow:
        low, high = _short(low), _short(high)
        a = low + (high & 1) + (high >> 1)
        return a & 0xFFFF, (a - high) & 0xFFFF
    b = (low - (high >> 1)) & 0xFFFF
    return (high + b - 0x8000) & 0xFFFF, b


def _level(v: np.ndarray, p: int, narrow: bool, forward: bool) -> None:
    """One level over a plane, in place; p is the distance between the samples that meet."""
    h, w = v.shape
    p2 = 2 * p
    ys, xs = slice(0, h - p2 + 1, p2), slice(0, w - p2 + 1, p2)
    ny, nx = len(range(*ys.indices(h))), len(range(*xs.indices(w)))
    at = lambda dy, dx: (slice(dy, dy + (ny - 1) * p2 + 1, p2), slice(dx, dx + (nx - 1) * p2 + 1, p2))
    if forward:
        i00, i01 = _enc(v[at(0, 0)], v[at(0, p)], narrow)
        i10, i11 = _enc(v[at(p, 0)], v[at(p, p)], narrow)
        v[at(0, 0)], v[at(p, 0)] = _enc(i00, i10, narrow)
        v[at(0, p)], v[at(p, p)] = _enc(i01, i11, narrow)
    else:
        i00, i10 = _dec(v[at(0, 0)], v[at(p, 0)], narrow)
        i01, i11 = _dec(v[at(0, p)], v[at(p, p)], narrow)
        v[at(0, 0)], v[at(0, p)] = _dec(i00, i01, narrow)
        v[at(p, 0)], v[at(p, p)] = _dec(i10, i11, narrow)
    step = _enc if forward else _dec
    if w & p:  # a last column without a partner
        x = nx * p2
        a, b = slice(0, (ny - 1) * p2 + 1, p2), slice(p, p + (ny - 1) * p2 + 1, p2)
        v[a, x], v[b, x] = step(v[a, x], v[b, x], narrow)
    if h & p:  # a last row
        y = ny * p2
        a, b = slice(0, (nx - 1) * p2 + 1, p2), slice(p, p + (nx - 1) * p2 + 1, p2)
        v[y, a], v[y, b] = step(v[y, a], v[y, b], narrow)


def wavelet(v: np.ndarray, largest: int, forward: bool) -> None:
    n, p, levels = min(v.shape), 1, []
    while 2 * p <= n:
        levels.append(p)
        p *= 2
    for p in levels if forward else reversed(levels):
        _level(v, p, largest < 1 << 14, forward)


# ---------------------------------------------------------------- Huffman


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical: longer codes come first, symbols in order."""
    n = [0] * 60
    for length in lengths.values():
        n[length] += 1
    code = 0
    for i in range(58, 0, -1):
        n[i], code = code, code + n[i] >> 1
    out = {}
    for s in sorted(lengths):
        out[s] = (n[lengths[s]], lengths[s])
        n[lengths[s]] += 1
    return out


class _Writer:
    def __init__(self):
        self.out, self.word, self.n, self.bits = bytearray(), 0, 0, 0

    def put(self, value: int, n: int) -> None:
        self.word, self.n, self.bits = self.word << n | value, self.n + n, self.bits + n
        while self.n >= 8:
            self.n -= 8
            self.out.append(self.word >> self.n & 255)
        self.word &= (1 << self.n) - 1

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.word << (8 - self.n) & 255]) if self.n else b"")


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = int.from_bytes(data, "big"), 0
        self.size = 8 * len(data)
        self.raw = data

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise FormatError("exr", "TruncatedHuffman")
        first, last = self.at >> 3, self.at + n + 7 >> 3
        word = int.from_bytes(self.raw[first:last], "big")
        self.at += n
        return word >> (8 * last - self.at) & ((1 << n) - 1)


def huffman_encode(values: np.ndarray) -> bytes:
    if not len(values):
        return b""
    symbols, counts = np.unique(values, return_counts=True)
    low, run = int(symbols[0]), int(symbols[-1]) + 1
    heap = [(int(c), [int(s)]) for s, c in zip(symbols, counts, strict=True)] + [(1, [run])]
    heapq.heapify(heap)
    lengths = dict.fromkeys([*map(int, symbols), run], 0)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, x + y))
    table, last = _Writer(), low - 1
    # Only symbols with a code are visited, not all 65,537; those between two of them have none and are runs of zeros.
    for s in sorted(lengths):
        zeros = s - last - 1
        while zeros:
            n = min(zeros, LONGEST)
            if n >= SHORTEST_LONG:
                table.put(LONG_RUN, 6)
                table.put(n - SHORTEST_LONG, 8)
            elif n >= 2:
                table.put(SHORT_RUN + n - 2, 6)
            else:
                table.put(0, 6)
            zeros -= n
        table.put(lengths[s], 6)
        last = s
    codes, body = _codes(lengths), _Writer()
    edges = np.flatnonzero(np.diff(values)) + 1
    for a, b in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(values)])), strict=True):
        code, size = codes[int(values[a])]
        left = int(b - a)
        while left:
            more = min(left, 256) - 1
            if size + codes[run][1] + 8 < size * more:
                body.put(code, size)
                body.put(*codes[run])
                body.put(more, 8)
            else:
                for _ in range(more + 1):
                    body.put(code, size)
            left -= more + 1
    packed = table.done()
    return struct.pack("<5I", low, run, len(packed), body.bits, 0) + packed + body.done()


def huffman_decode(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    if len(data) < 20:
        raise FormatError("exr", "TruncatedHuffman")
    low, run, size, bits, _ = struct.unpack("<5I", data[:20])
    if low >= SYMBOLS or run >= SYMBOLS:
        raise FormatError("exr", "BadHuffman", "symbols")
    table, lengths, s = _Reader(data[20:]), {}, low
    while s <= run:
        k = table.take(6)
        if k == LONG_RUN:
            s += table.take(8) + SHORTEST_LONG
        elif k >= SHORT_RUN:
            s += k - SHORT_RUN + 2
        else:
            if k:
                lengths[s] = k
            s += 1
    at = 20 + (table.at + 7) // 8
    if 8 * (len(data) - at) < bits:
        raise FormatError("exr", "TruncatedHuffman")
    lookup = {(length, code): s for s, (code, length) in _codes(lengths).items()}
    shortest, body, out = min(lengths.values()), _Reader(data[at:]), []
    while body.at < bits:
        length = shortest
        code = body.take(length)
        while (length, code) not in lookup:
            if length >= 58:
                raise FormatError("exr", "BadCode")
            code, length = code << 1 | body.take(1), length + 1
        s = lookup[length, code]
        if s == run:
            if not out:
                raise FormatError("exr", "BadCode", "run at the start")
            out += [out[-1]] * body.take(8)
        else:
            out.append(s)
        if len(out) > n:
            raise FormatError("exr", "BadHuffman", "too many values")
    if len(out) != n:
        raise FormatError("exr", "BadHuffman", f"{len(out)} values of {n}")
    return np.array(out, np.int64)


# ---------------------------------------------------------------- chunks


def planes_of(words: np.ndarray, shapes: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Views (rows, columns, words per value) of channels that follow one another."""
    out, at = [], 0
    for h, w, k in shapes:
        out.append(words[at : at + h * w * k].reshape(h, w, k))
        at += h * w * k
    return out


def compress(words: np.ndarray, shapes: list[tuple[int, int, int]]) -> bytes:
    """words: 16-bit values, channel by channel."""
    present = np.zeros(65_536, bool)
    present[words] = True
    present[0] = False  # zero always counts
    bitmap = np.packbits(present, bitorder="little")
    used = np.flatnonzero(bitmap)
    first, last = (int(used[0]), int(used[-1])) if len(used) else (8191, 0)
    present[0] = True
    rank = np.cumsum(present) - 1
    v = rank[words].astype(np.int64)
    for plane in planes_of(v, shapes):
        for k in range(plane.shape[2]):
            wavelet(plane[:, :, k], int(rank[-1]), True)
    packed = huffman_encode(v)
    return struct.pack("<HH", first, last) + (bitmap[first : last + 1].tobytes() if first <= last else b"") + struct.pack("<I", len(packed)) + packed


def decompress(data: bytes, shapes: list[tuple[int, int, int]]) -> np.ndarray:
    first, last = struct.unpack("<HH", data[:4])
    if last >= 8192:
        raise FormatError("exr", "BadBitmap")
    bitmap, at = np.zeros(8192, np.uint8), 4
    if first <= last:
        bitmap[first : last + 1] = np.frombuffer(data, np.uint8, last - first + 1, 4)
        at += last - first + 1
    present = np.unpackbits(bitmap, bitorder="little").astype(bool)
    present[0] = True
    values = np.flatnonzero(present)
    (n,) = struct.unpack("<I", data[at : at + 4])
    total = sum(h * w * k for h, w, k in shapes)
    v = huffman_decode(data[at + 4 : at + 4 + n], total)
    for plane in planes_of(v, shapes):
        for k in range(plane.shape[2]):
            wavelet(plane[:, :, k], len(values) - 1, False)
    if len(v) and int(v.max()) >= len(values):
        raise FormatError("exr", "BadValue")
    return values[v].astype(np.uint16)
