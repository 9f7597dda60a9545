"""VP8 key frames, the lossy images of WebP, after RFC 6386: decoding whole, encoding with 16 x 16 and 8 x 8 prediction.

Three tables of the format have about a thousand entries each: the default probabilities of coefficients, the
probabilities of their updates, and those of 4 x 4 prediction modes. They are a parameter: `tables_of` takes them from
the RFC's text, whose path is the user's to name, and nothing is decoded without them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from imagelake.sources.base import FormatError, Limits

# Quantiser steps by index, for the first coefficient and for the others.
DC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 10, 11, 12, 13, 14, 15, 16, 17, 17, 18, 19, 20, 20, 21, 21, 22, 22, 23, 23, 24, 25, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 37, 38, 39, 40, 41, 42, 43,
    44, 45, 46, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 76, 77, 78, 79, 80, 81, 82, 83, 84, 85, 86, 87,
    88, 89, 91, 93, 95, 96, 98, 100, 101, 102, 104, 106, 108, 110, 112, 114, 116, 118, 122, 124, 126, 128, 130, 132, 134, 136, 138, 140, 143, 145, 148, 151, 154, 157,
)
AC_STEPS = (
    4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51,
    52, 53, 54, 55, 56, 57, 58, 60, 62, 64, 66, 68, 70, 72, 74, 76, 78, 80, 82, 84, 86, 88, 90, 92, 94, 96, 98, 100, 102, 104, 106, 108, 110, 112, 114, 116, 119, 122, 125, 128, 131, 134, 137,
    140, 143, 146, 149, 152, 155, 158, 161, 164, 167, 170, 173, 177, 181, 185, 189, 193, 197, 201, 205, 209, 213, 217, 221, 225, 229, 234, 239, 245, 249, 254, 259, 264, 269, 274, 279, 284,
)
# The order of a block's coefficients, and the band of each place in that order.
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
# Probabilities of the extra bits of large coefficients, and the least value of each kind.
EXTRA = ((159,), (165, 145), (173, 148, 140), (176, 155, 140, 135), (180, 157, 141, 134, 130), (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129))
LEAST = (5, 7, 11, 19, 35, 67)
# Trees as (left, right) by node, leaves negative: -1 - value; the modes of key frames and their probabilities.
DC, V, H, TM, B = range(5)
Y_TREE, Y_PROBS = ((-1 - B, 1), (2, 3), (-1 - DC, -1 - V), (-1 - H, -1 - TM)), (145, 156, 163, 128)
UV_TREE, UV_PROBS = ((-1 - DC, 1), (-1 - V, 2), (-1 - H, -1 - TM)), (142, 114, 183)
B_DC, B_TM, B_VE, B_HE, B_LD, B_RD, B_VR, B_VL, B_HD, B_HU = range(10)
B_TREE = ((-1 - B_DC, 1), (-1 - B_TM, 2), (-1 - B_VE, 3), (4, 6), (-1 - B_HE, 5), (-1 - B_RD, -1 - B_VR), (-1 - B_LD, 7), (-1 - B_VL, 8), (-1 - B_HD, -1 - B_HU))
SEGMENT_TREE = ((1, 2), (-1, -2), (-3, -4))
#: The 4 x 4 mode that neighbours see of a 16 x 16 one.
SEEN = {DC: B_DC, V: B_VE, H: B_HE, TM: B_TM}


@dataclass(frozen=True)
class Tables:
    """coefficients and updates: [block kind 4][band 8][context 3][11]; modes: [above 10][left 10][9]."""

    coefficients: tuple
    updates: tuple
    modes: tuple


def tables_of(text: str) -> Tables:
    """From the text of the RFC: the numbers of the three arrays, by their names there."""

    # Without the feet and heads of its pages, and without comments.
    text = re.sub(r"^(?:Bankoski, et al\.|RFC 6386 ).*$", " ", text, flags=re.MULTILINE)
    text = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.DOTALL)

    def numbers(name: str, *shape: int) -> tuple:
        found = re.search(rf"{name}\s*(?:\[[^\]]*\]\s*)+=\s*\{{(.*?)\}}\s*;", text, re.DOTALL)
        if not found:
            raise FormatError("webp", "MissingTable", name)
        body = found[1]
        v = np.array([int(n) for n in re.findall(r"\d+", body)])
        if len(v) != np.prod(shape) or v.max() > 255:
            raise FormatError("webp", "MissingTable", f"{name} has {len(v)} entries")
        return tuple_of(v.reshape(shape))

    return Tables(numbers("default_coeff_probs", 4, 8, 3, 11), numbers("coeff_update_probs", 4, 8, 3, 11), numbers("kf_bmode_probs", 10, 10, 9))


def tuple_of(v: np.ndarray) -> tuple:
    return tuple(map(tuple_of, v)) if v.ndim > 1 else tuple(v.tolist())


def even_tables() -> Tables:
    """All outcomes equally likely: tables by a rule, for streams that both sides read with them."""
    return Tables(tuple_of(np.full((4, 8, 3, 11), 128)), tuple_of(np.full((4, 8, 3, 11), 255)), tuple_of(np.full((10, 10, 9), 128)))


# ---------------------------------------------------------------- arithmetic coding


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.range, self.left = data, 0, 0, 255, -8
        self._fill()

    def _fill(self) -> None:
        """left: bits below the eight that are compared."""
        while self.left < 0:
            part = self.data[self.at : self.at + 8]
            if len(part) < 8:
                if self.at > len(self.data) + 16:
                    raise FormatError("webp", "TruncatedData", "partition")
                part = part + bytes(8 - len(part))
            self.at += 8
            self.value, self.left = self.value << 64 | int.from_bytes(part, "big"), self.left + 64

    def bit(self, probability: int = 128) -> int:
        split = 1 + ((self.range - 1) * probability >> 8)
        if self.value >> self.left >= split:
            self.value -= split << self.left
            self.range -= split
            out = 1
        else:
            self.range, out = split, 0
        shift = 8 - self.range.bit_length()
        if shift:
            self.range <<= shift
            self.left -= shift
            if self.left < 0:
                self._fill()
        return out

    def number(self, bits: int) -> int:
        out = 0
        for _ in range(bits):
            out = out << 1 | self.bit()
        return out

    def signed(self, bits: int) -> int:
        v = self.number(bits)
        return -v if self.bit() else v

    def optional(self, bits: int) -> int:
        return self.signed(bits) if self.bit() else 0

    def tree(self, tree, probabilities, node: int = 0) -> int:
        while True:
            node = tree[node][self.bit(probabilities[node])]
            if node < 0:
                return -1 - node


class Writer:
    def __init__(self):
        self.out, self.low, self.range, self.count = bytearray(), 0, 255, 24

    def bit(self, value: int, probability: int = 128) -> None:
        split = 1 + ((self.range - 1) * probability >> 8)
        if value:
            self.low += split
            self.range -= split
        else:
            self.range = split
        while self.range < 128:
            self.range <<= 1
            if self.low >> 31:  # a carry
                at = len(self.out) - 1
                while self.out[at] == 255:
                    self.out[at] = 0
                    at -= 1
                self.out[at] += 1
            self.low = self.low << 1 & 0xFFFFFFFF
            self.count -= 1
            if not self.count:
                self.out.append(self.low >> 24)
                self.low &= 0xFFFFFF
                self.count = 8

    def number(self, value: int, bits: int) -> None:
        for k in range(bits - 1, -1, -1):
            self.bit(value >> k & 1)

    def tree(self, tree, probabilities, value: int, start: int = 0) -> None:
        for node, side in path_to(tree, value, start):
            self.bit(side, probabilities[node])

    def done(self) -> bytes:
        for _ in range(32):
            self.bit(0)
        return bytes(self.out)


def path_to(tree, value: int, node: int = 0) -> list[tuple[int, int]]:
    for side in (0, 1):
        to = tree[node][side]
        if to == -1 - value:
            return [(node, side)]
        if to >= 0 and (rest := path_to(tree, value, to)):
            return [(node, side), *rest]
    return []


# ---------------------------------------------------------------- transforms

_C, _S = 20091, 35468
_WHT = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]])
_IDCT = np.array([[1, 1 + _C / 65536, 1, _S / 65536], [1, _S / 65536, -1, -1 - _C / 65536], [1, -_S / 65536, -1, 1 + _C / 65536], [1, -1 - _C / 65536, 1, -_S / 65536]])
_FORWARD, _FORWARD_WHT = np.linalg.inv(_IDCT), np.linalg.inv(_WHT)


def _pass(i: np.ndarray) -> np.ndarray:
    """One direction of the inverse transform, along the second last axis, in its integer form."""
    a, b, c, d = (i[..., k, :] for k in range(4))
    low = (b * _S >> 16) - (d + (d * _C >> 16))
    high = b + (b * _C >> 16) + (d * _S >> 16)
    return np.stack((a + c + high, a - c + low, a - c - low, a + c - high), -2)


def inverse(blocks: np.ndarray) -> np.ndarray:
    """(..., 4, 4) of coefficients to residuals."""
    return (_pass(_pass(blocks).swapaxes(-1, -2)) + 4 >> 3).swapaxes(-1, -2)


def inverse_wht(block: np.ndarray) -> np.ndarray:
    return _WHT @ block @ _WHT.T + 3 >> 3


def forward(blocks: np.ndarray) -> np.ndarray:
    return np.rint(8 * _FORWARD @ blocks @ _FORWARD.T).astype(np.int64)


def forward_wht(block: np.ndarray) -> np.ndarray:
    return np.rint(8 * _FORWARD_WHT @ block @ _FORWARD_WHT.T).astype(np.int64)


def steps_of(index: int, deltas: tuple[int, int, int, int, int] = (0, 0, 0, 0, 0)) -> tuple[tuple[int, int], ...]:
    """(first, other) steps of luma, of the second-order block and of chroma; deltas: luma first, second-order first and
    others, chroma first and others."""
    at = lambda d: min(127, max(0, index + d))
    y1, y2, y2a, uv, uva = deltas
    return (DC_STEPS[at(y1)], AC_STEPS[at(0)]), (2 * DC_STEPS[at(y2)], max(8, AC_STEPS[at(y2a)] * 155 // 100)), (min(132, DC_STEPS[at(uv)]), AC_STEPS[at(uva)])


# ---------------------------------------------------------------- prediction


def whole(mode: int, above: np.ndarray, left: np.ndarray, corner: int, top: bool, side: bool) -> np.ndarray:
    """A square from the row above and the column to the left; top, side: whether these lie within the frame."""
    n = len(above)
    if mode == V:
        return np.broadcast_to(above, (n, n))
    if mode == H:
        return np.broadcast_to(left[:, None], (n, n))
    if mode == TM:
        return np.clip(left[:, None] + above[None, :] - corner, 0, 255)
    known = ([above] if top else []) + ([left] if side else [])
    total, count = sum(int(v.sum()) for v in known), n * len(known)
    return np.full((n, n), (total + count // 2) // count if count else 128)


def small(mode: int, a: list[int], left: list[int], corner: int) -> np.ndarray:
    """A 4 x 4 block from eight pixels above and to the right, four to the left, and the corner."""
    e = [*left[::-1], corner, *a]  # from below left around the corner to above right
    two = lambda i: (e[i] + e[i + 1] + 1) >> 1
    three = lambda i: (e[i - 1] + 2 * e[i] + e[i + 1] + 2) >> 2
    if mode == B_DC:
        return np.full((4, 4), (sum(a[:4]) + sum(left) + 4) >> 3)
    if mode == B_TM:
        return np.clip(np.array(left)[:, None] + np.array(a[:4])[None, :] - corner, 0, 255)
    if mode == B_VE:
        return np.broadcast_to([three(5 + c) for c in range(4)], (4, 4))
    if mode == B_HE:
        rows = [three(3), three(2), three(1), (left[2] + 3 * left[3] + 2) >> 2]
        return np.broadcast_to(np.array(rows)[:, None], (4, 4))
    if mode == B_LD:
        run = [three(6 + i) for i in range(6)] + [(a[6] + 3 * a[7] + 2) >> 2]
        return np.array([[run[r + c] for c in range(4)] for r in range(4)])
    if mode == B_RD:
        return np.array([[three(4 - r + c) for c in range(4)] for r in range(4)])
    if mode == B_VR:
        even, odd = [two(4 + i) for i in range(4)], [three(4 + i) for i in range(4)]
        return np.array([even, odd, [three(3), *even[:3]], [three(2), *odd[:3]]])
    if mode == B_VL:
        even, odd = [two(5 + i) for i in range(5)], [three(6 + i) for i in range(6)]
        return np.array([even[:4], odd[:4], [*even[1:4], odd[4]], [*odd[1:4], odd[5]]])
    if mode == B_HD:
        run = [two(0), three(1), two(1), three(2), two(2), three(3), two(3), three(4), three(5), three(6)]
        return np.array([run[6:10], run[4:8], run[2:6], run[0:4]])
    l0, l1, l2, l3 = left
    run = [(l0 + l1 + 1) >> 1, (l0 + 2 * l1 + l2 + 2) >> 2, (l1 + l2 + 1) >> 1, (l1 + 2 * l2 + l3 + 2) >> 2, (l2 + l3 + 1) >> 1, (l2 + 3 * l3 + 2) >> 2, l3, l3, l3, l3]
    return np.array([run[2 * r : 2 * r + 4] for r in range(4)])


# ---------------------------------------------------------------- frames


@dataclass
class Header:
    width: int
    height: int
    segments: bool = False
    map_: bool = False
    absolute: bool = False
    quantisers: list[int] = field(default_factory=lambda: [0] * 4)
    levels: list[int] = field(default_factory=lambda: [0] * 4)
    map_probabilities: list[int] = field(default_factory=lambda: [255] * 3)
    simple: bool = False
    level: int = 0
    sharpness: int = 0
    adjust: bool = False
    by_frame: list[int] = field(default_factory=lambda: [0] * 4)
    by_mode: list[int] = field(default_factory=lambda: [0] * 4)
    partitions: int = 1
    index: int = 0
    deltas: tuple = (0,) * 5
    skipping: int | None = None
    coefficients: list = field(default_factory=list)


def read_header(data: bytes, limits: Limits, tables: Tables) -> tuple[Header, Reader, int]:
    """The header, the reader of the first partition, and where the others begin."""
    if len(data) < 10:
        raise FormatError("webp", "TruncatedData", "frame header")
    tag = int.from_bytes(data[:3], "little")
    if tag & 1 or data[3:6] != b"\x9d\x01\x2a":
        raise FormatError("webp", "BadFrame", "no key frame")
    if tag >> 1 & 7 > 3:
        raise FormatError("webp", "Unsupported.Webp.Profile", str(tag >> 1 & 7))
    size = tag >> 5
    h = Header(int.from_bytes(data[6:8], "little") & 0x3FFF, int.from_bytes(data[8:10], "little") & 0x3FFF)
    if not h.width or not h.height or 10 + size > len(data):
        raise FormatError("webp", "BadFrame", "extent or first partition")
    limits.check(h.width, h.height)
    r = Reader(data[10 : 10 + size])
    r.number(2)  # colour space, and whether pixels need clamping: they are clamped
    h.segments = bool(r.bit())
    if h.segments:
        h.map_, values = bool(r.bit()), r.bit()
        if values:
            h.absolute = bool(r.bit())
            h.quantisers = [r.optional(7) for _ in range(4)]
            h.levels = [r.optional(6) for _ in range(4)]
        if h.map_:
            h.map_probabilities = [r.number(8) if r.bit() else 255 for _ in range(3)]
    h.simple, h.level, h.sharpness, h.adjust = bool(r.bit()), r.number(6), r.number(3), bool(r.bit())
    if h.adjust and r.bit():
        h.by_frame = [r.optional(6) for _ in range(4)]
        h.by_mode = [r.optional(6) for _ in range(4)]
    h.partitions = 1 << r.number(2)
    h.index, h.deltas = r.number(7), tuple(r.optional(4) for _ in range(5))
    r.bit()  # whether the probabilities are for later frames as well
    h.coefficients = [[[list(c) for c in band] for band in kind] for kind in tables.coefficients]
    for kind, likely in zip(h.coefficients, tables.updates, strict=True):
        for band, b in zip(kind, likely, strict=True):
            for context, p in zip(band, b, strict=True):
                for k in range(11):
                    if r.bit(p[k]):
                        context[k] = r.number(8)
    h.skipping = r.number(8) if r.bit() else None
    return h, r, 10 + size


def read_block(r: Reader, probabilities, first: int, context: int, steps: tuple[int, int], out: list[int]) -> bool:
    """Coefficients of a block, dequantised into natural order; whether there are any."""
    at, p, fresh = first, None, True
    while at < 16:
        p = probabilities[BANDS[at]][context]
        if fresh and not r.bit(p[0]):
            break
        if not r.bit(p[1]):
            context, fresh, at = 0, False, at + 1
            continue
        if not r.bit(p[2]):
            v, context = 1, 1
        else:
            context = 2
            if not r.bit(p[3]):
                v = 2 if not r.bit(p[4]) else 3 + r.bit(p[5])
            elif not r.bit(p[6]):
                kind = r.bit(p[7])
                v = _extra(r, kind)
            else:
                high = r.bit(p[8])
                v = _extra(r, 2 + 2 * high + r.bit(p[9 + high]))
        out[ZIGZAG[at]] = (-v if r.bit() else v) * steps[at > 0]
        fresh, at = True, at + 1
    return at > first if p is not None else False


def _extra(r: Reader, kind: int) -> int:
    v = 0
    for p in EXTRA[kind]:
        v = v << 1 | r.bit(p)
    return LEAST[kind] + v


@dataclass
class Planes:
    """Y, U and V with a border: a row of 127 above, a column of 129 to the left."""

    y: np.ndarray
    u: np.ndarray
    v: np.ndarray

    @staticmethod
    def of(rows: int, columns: int) -> Planes:
        made = []
        for n in (16, 8, 8):
            p = np.zeros((rows * n + 1, columns * n + 1), np.int64)
            p[:, 0], p[0] = 129, 127
            made.append(p)
        return Planes(*made)


def edges(plane: np.ndarray, y: int, x: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Above, left and corner of the square whose first pixel, without the border, is (y, x)."""
    return plane[y, x + 1 : x + n + 1], plane[y + 1 : y + n + 1, x], int(plane[y, x])


def add(plane: np.ndarray, y: int, x: int, guess: np.ndarray, blocks: np.ndarray) -> None:
    """Prediction and the residuals of the 4 x 4 blocks in row order."""
    n = len(guess)
    k = n // 4
    rest = inverse(blocks.reshape(k * k, 4, 4)).reshape(k, k, 4, 4).swapaxes(1, 2).reshape(n, n)
    plane[y + 1 : y + n + 1, x + 1 : x + n + 1] = np.clip(guess + rest, 0, 255)


def decode_frame(data: bytes, limits: Limits, tables: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, Header]:
    """Planes of the frame, in whole macroblocks."""
    h, r, at = read_header(data, limits, tables)
    columns, rows = -(-h.width // 16), -(-h.height // 16)
    starts = at + 3 * (h.partitions - 1)
    readers = []
    for k in range(h.partitions):
        size = int.from_bytes(data[at + 3 * k : at + 3 * k + 3], "little") if k < h.partitions - 1 else len(data) - starts
        if size < 0 or starts + size > len(data):
            raise FormatError("webp", "BadFrame", f"partition {k}")
        readers.append(Reader(data[starts : starts + size]))
        starts += size
    steps = []
    for s in range(4):
        index = (h.quantisers[s] if h.absolute else h.index + h.quantisers[s]) if h.segments else h.index
        steps.append(steps_of(min(127, max(0, index)), h.deltas))
    p = Planes.of(rows, columns)
    above_modes = np.zeros((columns, 4), int)
    above_seen = np.zeros((columns, 9), int)
    filters = []
    for my in range(rows):
        left_modes, left_seen, tokens = [B_DC] * 4, [0] * 9, readers[my % h.partitions]
        for mx in range(columns):
            segment = r.tree(SEGMENT_TREE, h.map_probabilities) if h.map_ else 0
            skip = bool(r.bit(h.skipping)) if h.skipping is not None else False
            mode = r.tree(Y_TREE, Y_PROBS)
            modes = []
            if mode == B:
                for j in range(4):
                    for i in range(4):
                        m = r.tree(B_TREE, tables.modes[above_modes[mx, i]][left_modes[j]])
                        above_modes[mx, i] = left_modes[j] = m
                        modes.append(m)
            else:
                above_modes[mx], left_modes = SEEN[mode], [SEEN[mode]] * 4
            uv = r.tree(UV_TREE, UV_PROBS)
            blocks, found = [[0] * 16 for _ in range(25)], False
            if skip:
                seen = above_seen[mx, 8], left_seen[8]
                above_seen[mx], left_seen = 0, [0] * 9
                if mode == B:  # without a second-order block its context stays
                    above_seen[mx, 8], left_seen[8] = seen
            else:
                found = read_blocks(tokens, h.coefficients, steps[segment], mode == B, above_seen[mx], left_seen, blocks)
            rebuild(p, my, mx, columns, mode, modes, uv, np.array(blocks))
            filters.append((my, mx, segment, mode, found or mode == B))
    soften(h, p, filters)
    return p.y[1:, 1:], p.u[1:, 1:], p.v[1:, 1:], h


def read_blocks(r: Reader, probabilities, steps, small_blocks: bool, above, left, blocks: list[list[int]]) -> bool:
    """All blocks of a macroblock; above and left: whether the blocks beside had coefficients, four of Y, two of U and V each,
    one of the second order."""
    found = False
    if not small_blocks:
        some = read_block(r, probabilities[1], 0, above[8] + left[8], steps[1], blocks[24])
        above[8] = left[8] = int(some)
        found |= some
        for k, v in enumerate(inverse_wht(np.array(blocks[24]).reshape(4, 4)).ravel().tolist()):
            blocks[k][0] = v
    for k in range(24):
        if k < 16:
            i, j, kind, first, step = k % 4, k // 4, 3 if small_blocks else 0, 0 if small_blocks else 1, steps[0]
        else:
            base = 4 + (k - 16) // 4 * 2
            i, j, kind, first, step = base + k % 2, base + k // 2 % 2, 2, 0, steps[2]
        some = read_block(r, probabilities[kind], first, above[i] + left[j], step, blocks[k])
        above[i] = left[j] = int(some)
        found |= some
    return found


def rebuild(p: Planes, my: int, mx: int, columns: int, mode: int, modes: list[int], uv: int, blocks: np.ndarray) -> None:
    y, x = 16 * my, 16 * mx
    if mode != B:
        add(p.y, y, x, whole(mode, *edges(p.y, y, x, 16), my > 0, mx > 0), blocks[:16])
    else:
        # What stands above to the right of the macroblock serves all its rows; beyond the frame the last pixel repeats.
        beyond = p.y[y, x + 17 : x + 21].tolist() if mx + 1 < columns else [int(p.y[y, x + 16])] * 4
        for k, m in enumerate(modes):
            by, bx = y + k // 4 * 4, x + k % 4 * 4
            above, left, corner = edges(p.y, by, bx, 4)
            right = beyond if k % 4 == 3 else p.y[by, bx + 5 : bx + 9].tolist()
            add(p.y, by, bx, small(m, above.tolist() + right, left.tolist(), corner), blocks[k : k + 1])
    for plane, part in ((p.u, blocks[16:20]), (p.v, blocks[20:24])):
        add(plane, 8 * my, 8 * mx, whole(uv, *edges(plane, 8 * my, 8 * mx, 8), my > 0, mx > 0), part)


# ---------------------------------------------------------------- loop filter


def _common(p1, p0, q0, q1, outer):
    a = np.clip(np.where(outer, np.clip(p1 - q1, -128, 127), 0) + 3 * (q0 - p0), -128, 127)
    b, a = np.clip(a + 3, -128, 127) >> 3, np.clip(a + 4, -128, 127) >> 3
    return np.clip(p0 + b, -128, 127), np.clip(q0 - a, -128, 127), a


def smooth(lines: np.ndarray, simple: bool, big: bool, edge: int, inner: int, steep: int) -> None:
    """Filters along the last axis, of eight pixels across an edge, in place."""
    p3, p2, p1, p0, q0, q1, q2, q3 = (lines[..., k] for k in range(8))
    on = 2 * np.abs(p0 - q0) + (np.abs(p1 - q1) >> 1) <= edge
    s = lines - 128
    if simple:
        a, b, _ = _common(s[..., 2], s[..., 3], s[..., 4], s[..., 5], True)
        lines[..., 3], lines[..., 4] = np.where(on, a + 128, p0), np.where(on, b + 128, q0)
        return
    for a, b in ((p3, p2), (p2, p1), (p1, p0), (q1, q0), (q2, q1), (q3, q2)):
        on &= np.abs(a - b) <= inner
    high = (np.abs(p1 - p0) > steep) | (np.abs(q1 - q0) > steep)
    out = s.copy()
    a, b, step = _common(s[..., 2], s[..., 3], s[..., 4], s[..., 5], high if not big else True)
    if big:
        w = np.clip(np.clip(s[..., 2] - s[..., 5], -128, 127) + 3 * (s[..., 4] - s[..., 3]), -128, 127)
        for k, n in enumerate((27, 18, 9)):
            d = np.clip(n * w + 63 >> 7, -128, 127)
            out[..., 3 - k] = np.where(high, s[..., 3 - k], np.clip(s[..., 3 - k] + d, -128, 127))
            out[..., 4 + k] = np.where(high, s[..., 4 + k], np.clip(s[..., 4 + k] - d, -128, 127))
        out[..., 3], out[..., 4] = np.where(high, a, out[..., 3]), np.where(high, b, out[..., 4])
    else:
        half = step + 1 >> 1
        out[..., 3], out[..., 4] = a, b
        out[..., 2] = np.where(high, s[..., 2], np.clip(s[..., 2] + half, -128, 127))
        out[..., 5] = np.where(high, s[..., 5], np.clip(s[..., 5] - half, -128, 127))
    lines[...] = np.where(on[..., None], out + 128, lines)


def soften(h: Header, p: Planes, blocks: list[tuple[int, int, int, int, bool]]) -> None:
    """Macroblocks in order: their left edge, the edges within, the upper edge, the edges within."""
    if not h.level:
        return
    for my, mx, segment, mode, inside in blocks:
        level = h.level
        if h.segments:
            level = h.levels[segment] if h.absolute else level + h.levels[segment]
            level = min(63, max(0, level))
        if h.adjust:
            level = min(63, max(0, level + h.by_frame[0] + (h.by_mode[0] if mode == B else 0)))
        if not level:
            continue
        inner = level >> (2 if h.sharpness > 4 else 1) if h.sharpness else level
        inner = max(1, min(inner, 9 - h.sharpness) if h.sharpness else inner)
        steep = 2 if level >= 40 else 1 if level >= 15 else 0
        for plane, n in ((p.y, 16),) if h.simple else ((p.y, 16), (p.u, 8), (p.v, 8)):
            inner_plane = plane[1:, 1:]
            for across in (True, False):
                view = inner_plane if across else inner_plane.T
                row, column = (my, mx) if across else (mx, my)
                for k in range(0, n, 4):
                    at = column * n + k
                    if (k and not inside) or at == 0:
                        continue
                    edge = 2 * (level + (0 if k else 2)) + inner
                    smooth(view[row * n : row * n + n, at - 4 : at + 4], h.simple, not k, edge, inner, steep)


# ---------------------------------------------------------------- colour


def upsampled(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Chroma for every pixel: three parts of the nearest sample and one of the next, in both directions, rounded once."""
    ch, cw = -(-height // 2), -(-width // 2)
    c = plane[:ch, :cw]
    y = np.arange(height)
    rows = 3 * c[y // 2] + c[np.clip(y // 2 + np.where(y % 2, 1, -1), 0, ch - 1)]
    x = np.arange(width)
    return 3 * rows[:, x // 2] + rows[:, np.clip(x // 2 + np.where(x % 2, 1, -1), 0, cw - 1)] + 8 >> 4


#: Of luma, of red from V, of green from U and V, of blue from U, in parts of 65,536.
_RGB = tuple(round(c * 65536) for c in (1.164383562, 1.596027, -0.391762, -0.812968, 2.017232))


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray, height: int, width: int) -> np.ndarray:
    light, cb, cr = (y[:height, :width] - 16) * _RGB[0] + 32768, upsampled(u, height, width) - 128, upsampled(v, height, width) - 128
    made = light + cr * _RGB[1], light + cb * _RGB[2] + cr * _RGB[3], light + cb * _RGB[4]
    return np.clip(np.stack([m >> 16 for m in made], 2), 0, 255).astype(np.uint8)


def decode(data: bytes, limits: Limits, tables: Tables) -> np.ndarray:
    """(height, width, RGB)."""
    y, u, v, h = decode_frame(data, limits, tables)
    return to_rgb(y, u, v, h.height, h.width)


# ---------------------------------------------------------------- encoding


def from_rgb(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes in whole macroblocks, edges repeated; chroma from sums over 2 x 2."""
    h, w, _ = rgb.shape
    full = np.pad(rgb.astype(np.int64), ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge")
    y = (full @ [16839, 33059, 6420] + 32768 >> 16) + 16
    four = full.reshape(full.shape[0] // 2, 2, full.shape[1] // 2, 2, 3).sum((1, 3))
    return y, (four @ [-9719, -19081, 28800] + 131072 >> 18) + 128, (four @ [28800, -24116, -4684] + 131072 >> 18) + 128


def write_block(w: Writer, probabilities, first: int, context: int, levels: list[int]) -> bool:
    last = max((k for k in range(first, 16) if levels[k]), default=-1)
    fresh = True
    for at in range(first, 16):
        p = probabilities[BANDS[at]][context]
        if fresh:
            w.bit(int(at <= last), p[0])
        if at > last:
            break
        v = abs(levels[at])
        w.bit(int(v > 0), p[1])
        if not v:
            context, fresh = 0, False
            continue
        w.bit(int(v > 1), p[2])
        if v > 1:
            w.bit(int(v > 4), p[3])
            if v <= 4:
                w.bit(int(v > 2), p[4])
                if v > 2:
                    w.bit(v - 3, p[5])
            else:
                kind = max(k for k in range(6) if v >= LEAST[k])
                w.bit(int(kind > 1), p[6])
                if kind < 2:
                    w.bit(kind, p[7])
                else:
                    w.bit(int(kind > 3), p[8])
                    w.bit(kind % 2, p[9 + (kind > 3)])
                rest, n = v - LEAST[kind], len(EXTRA[kind])
                for i, q in enumerate(EXTRA[kind]):
                    w.bit(rest >> (n - 1 - i) & 1, q)
        w.bit(int(levels[at] < 0))
        context, fresh = min(v, 2), True
    return last >= first


def _levels(coefficients: np.ndarray, steps: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rounded to steps: (levels in zigzag order, what the decoder makes of them)."""
    step = np.full(16, steps[1])
    step[0] = steps[0]
    flat = coefficients.reshape(-1, 16)
    levels = np.sign(flat) * np.minimum((np.abs(flat) + step // 2) // step, 2047)
    return levels[:, list(ZIGZAG)], levels * step


def encode(rgb: np.ndarray, quality: int, tables: Tables, modes: int = 4) -> bytes:
    """A key frame. modes: how many of DC, vertical, horizontal and true motion are tried; the least squared error wins."""
    if not 0 <= quality <= 100:
        raise FormatError("webp", "BadOption", str(quality))
    h, w, _ = rgb.shape
    source = from_rgb(rgb)
    index = (127 * (100 - quality) + 50) // 100
    steps = steps_of(index)
    rows, columns = source[0].shape[0] // 16, source[0].shape[1] // 16
    p, head, tokens = Planes.of(rows, columns), Writer(), Writer()
    head.number(0, 2)
    head.bit(0)  # one segment
    head.number(0, 1 + 6 + 3 + 1)  # no loop filter
    head.number(0, 2)  # one partition
    head.number(index, 7)
    head.number(0, 5)
    head.bit(0)
    for kind in tables.updates:
        for band in kind:
            for context in band:
                for q in context:
                    head.bit(0, q)
    head.bit(0)  # every macroblock has its tokens
    above = np.zeros((columns, 9), int)
    for my in range(rows):
        left = [0] * 9
        for mx in range(columns):
            chosen, coded = [], []
            for planes, n in (((p.y,), 16), ((p.u, p.v), 8)):
                y, x = n * my, n * mx
                wanted = [source[k + (n == 8)][y : y + n, x : x + n] for k in range(len(planes))]
                tried = []
                for mode in range(modes):
                    guess = [whole(mode, *edges(q, y, x, n), my > 0, mx > 0) for q in planes]
                    tried.append((sum(int(((a - g) ** 2).sum()) for a, g in zip(wanted, guess, strict=True)), mode, guess))
                _, mode, guess = min(tried, key=lambda t: t[:2])
                chosen.append(mode)
                for q, a, g in zip(planes, wanted, guess, strict=True):
                    k = n // 4
                    coded.append((q, y, x, n, g, forward((a - g).reshape(k, 4, k, 4).swapaxes(1, 2).reshape(k * k, 4, 4))))
            head.tree(Y_TREE, Y_PROBS, chosen[0])
            head.tree(UV_TREE, UV_PROBS, chosen[1])
            luma = coded[0][5]
            second, made = _levels(forward_wht(luma[:, 0, 0].reshape(4, 4)), steps[1])
            luma[:, 0, 0] = 0
            some = write_block(tokens, tables.coefficients[1], 0, above[mx, 8] + left[8], second[0].tolist())
            above[mx, 8] = left[8] = int(some)
            firsts = inverse_wht(made.reshape(4, 4)).ravel()
            for part, (q, y, x, n, g, blocks) in enumerate(coded):
                levels, back = _levels(blocks, steps[0] if n == 16 else steps[2])
                if n == 16:
                    back[:, 0] = firsts
                for k, one in enumerate(levels.tolist()):
                    i, j = (k % 4, k // 4) if n == 16 else (2 + 2 * part + k % 2, 2 + 2 * part + k // 2)
                    some = write_block(tokens, tables.coefficients[0 if n == 16 else 2], int(n == 16), above[mx, i] + left[j], one)
                    above[mx, i] = left[j] = int(some)
                add(q, y, x, g, back)
    first = head.done()
    if len(first) >= 1 << 19:
        raise FormatError("webp", "LimitExceeded", "the first partition")
    return (len(first) << 5 | 16).to_bytes(3, "little") + b"\x9d\x01\x2a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + first + tokens.done()
