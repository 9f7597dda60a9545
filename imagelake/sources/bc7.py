"""BC7 blocks, decoding only: eight modes, up to three subsets, rotation, separate alpha indices.

The tables are those of the Khronos Data Format Specification, chapter on BPTC compressed formats."""

from __future__ import annotations

import numpy as np

# Of each mode: subsets, partition bits, rotation bits, index-selection bit, colour bits, alpha bits,
# bit per endpoint, bit per subset, index bits, second index bits.
MODES = (
    (3, 4, 0, 0, 4, 0, 1, 0, 3, 0), (2, 6, 0, 0, 6, 0, 0, 1, 3, 0), (3, 6, 0, 0, 5, 0, 0, 0, 2, 0), (2, 6, 0, 0, 7, 0, 1, 0, 2, 0),
    (1, 0, 2, 1, 5, 6, 0, 0, 2, 3), (1, 0, 2, 0, 7, 8, 0, 0, 2, 2), (1, 0, 0, 0, 7, 7, 1, 0, 4, 0), (2, 6, 0, 0, 5, 5, 1, 0, 2, 0),
)
# Interpolation weights by index bits.
WEIGHTS = {2: (0, 21, 43, 64), 3: (0, 9, 18, 27, 37, 46, 55, 64), 4: (0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64)}
# The partitions into two subsets, the subset of each texel in row order.
TWO = (
    "0011001100110011", "0001000100010001", "0111011101110111", "0001001100110111", "0000000100010011", "0011011101111111",
    "0001001101111111", "0000000100110111", "0000000000010011", "0011011111111111", "0000000101111111", "0000000000010111",
    "0001011111111111", "0000000011111111", "0000111111111111", "0000000000001111", "0000100011101111", "0111000100000000",
    "0000000010001110", "0111001100010000", "0011000100000000", "0000100011001110", "0000000010001100", "0111001100110001",
    "0011000100010000", "0000100010001100", "0110011001100110", "0011011001101100", "0001011111101000", "0000111111110000",
    "0111000110001110", "0011100110011100", "0101010101010101", "0000111100001111", "0101101001011010", "0011001111001100",
    "0011110000111100", "0101010110101010", "0110100101101001", "0101101010100101", "0111001111001110", "0001001111001000",
    "0011001001001100", "0011101111011100", "0110100110010110", "0011110011000011", "0110011010011001", "0000011001100000",
    "0100111001000000", "0010011100100000", "0000001001110010", "0000010011100100", "0110110010010011", "0011011011001001",
    "0110001110011100", "0011100111000110", "0110110011001001", "0110001100111001", "0111111010000001", "0001100011100111",
    "0000111100110011", "0011001111110000", "0010001011101110", "0100010001110111",
)
# The partitions into three subsets.
THREE = (
    "0011001102212222", "0001001122112221", "0000200122112211", "0222002200110111", "0000000011221122", "0011001100220022",
    "0022002211111111", "0011001122112211", "0000000011112222", "0000111111112222", "0000111122222222", "0012001200120012",
    "0112011201120112", "0122012201220122", "0011011211221222", "0011200122002220", "0001001101121122", "0111001120012200",
    "0000112211221122", "0022002200221111", "0111011102220222", "0001000122212221", "0000001101220122", "0000110022102210",
    "0122012200110000", "0012001211222222", "0110122112210110", "0000011012211221", "0022110211020022", "0110011020022222",
    "0011012201220011", "0000200022112221", "0000000211221222", "0222002200120011", "0011001200220222", "0120012001200120",
    "0000111122220000", "0120120120120120", "0120201212010120", "0011220011220011", "0011112222000011", "0101010122222222",
    "0000000021212121", "0022112200221122", "0022001100220011", "0220122102201221", "0101222222220101", "0000212121212121",
    "0101010101012222", "0222011102220111", "0002111200021112", "0000211221122112", "0222011101110222", "0002111211120002",
    "0110011001102222", "0000000021122112", "0110011022222222", "0022001100110022", "0022112211220022", "0000000000002112",
    "0002000100020001", "0222122202221222", "0101222222222222", "0111201122012220",
)
# The texel whose index lacks its top bit, of the second subset of two, and of the second and third of three.
ANCHOR_TWO = (
    15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 2, 8, 2, 2, 8, 8, 15, 2, 8, 2, 2, 8, 8, 2, 2,
    15, 15, 6, 8, 2, 8, 15, 15, 2, 8, 2, 2, 2, 15, 15, 6, 6, 2, 6, 8, 15, 15, 2, 2, 15, 15, 15, 15, 15, 2, 2, 15,
)
ANCHOR_SECOND = (
    3, 3, 15, 15, 8, 3, 15, 15, 8, 8, 6, 6, 6, 5, 3, 3, 3, 3, 8, 15, 3, 3, 6, 10, 5, 8, 8, 6, 8, 5, 15, 15,
    8, 15, 3, 5, 6, 10, 8, 15, 15, 3, 15, 5, 15, 15, 15, 15, 3, 15, 5, 5, 5, 8, 5, 10, 5, 10, 8, 13, 15, 12, 3, 3,
)
ANCHOR_THIRD = (
    15, 8, 8, 3, 15, 15, 3, 8, 15, 15, 15, 15, 15, 15, 15, 8, 15, 8, 15, 3, 15, 8, 15, 8, 3, 15, 6, 10, 15, 15, 10, 8,
    15, 3, 15, 10, 10, 8, 9, 10, 6, 15, 8, 15, 3, 6, 6, 8, 15, 3, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 3, 15, 15, 8,
)


def subset_of(subsets: int, partition: int, texel: int) -> int:
    return int((TWO, THREE)[subsets - 2][partition][texel]) if subsets > 1 else 0


def anchors_of(subsets: int, partition: int) -> set[int]:
    return {0} | ({ANCHOR_TWO[partition]} if subsets == 2 else {ANCHOR_SECOND[partition], ANCHOR_THIRD[partition]} if subsets == 3 else set())


#: By number of subsets, of each partition: the texels' subsets, and whether their indices lack the top bit.
SUBSETS = {n: np.array([[subset_of(n, p, t) for t in range(16)] for p in range(64)]) for n in (1, 2, 3)}
ANCHORS = {n: np.array([[t in anchors_of(n, p) for t in range(16)] for p in range(64)]) for n in (1, 2, 3)}


class Words:
    """Fields of many blocks of 128 bits side by side, taken from the lowest bit on."""

    def __init__(self, raw: np.ndarray, at: int):
        self.low, self.high, self.at = raw[:, 0], raw[:, 1], at

    def take(self, n: int) -> np.ndarray:
        at = self.at
        self.at += n
        if at >= 64:
            v = self.high >> np.uint64(at - 64)
        else:
            v = self.low >> np.uint64(at) | (self.high << np.uint64(64 - at) if at else np.uint64(0))
        return (v & np.uint64((1 << n) - 1)).astype(np.int64)

    def indices(self, bits: int, lacking: np.ndarray) -> np.ndarray:
        """(blocks, 16) fields of `bits` each, one less where a texel is lacking one."""
        if (lacking == lacking[:1]).all():
            return np.stack([self.take(bits - int(short)) for short in lacking[0]], 1) if len(lacking) else np.empty((0, 16), np.int64)
        width = bits - lacking.astype(np.int64)  # of several subsets: these stand in the high word
        place = self.at - 64 + np.cumsum(width, 1) - width
        self.at += int(width[0].sum())
        return (self.high[:, None] >> place.astype(np.uint64)).astype(np.int64) & ((1 << width) - 1)


def _of_mode(mode: int, raw: np.ndarray) -> np.ndarray:
    subsets, pb, rb, sb, cb, ab, per_end, per_subset, ib, ib2 = MODES[mode]
    words, n = Words(raw, mode + 1), len(raw)
    partition, rotation, selection = words.take(pb), words.take(rb), words.take(sb)
    ends = np.full((n, subsets, 2, 4), 255, np.int64)
    each = [(s, e) for s in range(subsets) for e in range(2)]
    for c, bits in enumerate((cb, cb, cb, ab)):
        for s, e in each if bits else ():
            ends[:, s, e, c] = words.take(bits)
    extra = None
    if per_end or per_subset:
        extra = np.stack([words.take(1) for _ in range(2 * subsets if per_end else subsets)], 1).reshape(n, subsets, -1)
    for c, bits in enumerate((cb, cb, cb, ab)):
        if bits:
            v = ends[:, :, :, c] if extra is None else ends[:, :, :, c] << 1 | extra
            wide = bits + (extra is not None)
            ends[:, :, :, c] = v << (8 - wide) | v >> (2 * wide - 8)
    colour = alpha = np.array(WEIGHTS[ib])[words.indices(ib, ANCHORS[subsets][partition])]
    if ib2:
        second = np.array(WEIGHTS[ib2])[words.indices(ib2, ANCHORS[1][partition])]
        swapped = selection[:, None] == 1
        colour, alpha = np.where(swapped, second, colour), np.where(swapped, colour, second)
    w = np.stack((colour, colour, colour, alpha), 2)
    rows, subset = np.arange(n)[:, None], SUBSETS[subsets][partition]
    px = ((64 - w) * ends[rows, subset, 0] + w * ends[rows, subset, 1] + 32) >> 6
    for r in (1, 2, 3) if rb else ():
        own = np.flatnonzero(rotation == r)
        px[own[:, None], :, [3, r - 1]] = px[own[:, None], :, [r - 1, 3]]
    return px


def decode(raw: bytes, blocks: int) -> np.ndarray:
    """(blocks, 16, RGBA), all blocks of a mode at once; a reserved mode is opaque black."""
    words = np.frombuffer(raw, "<u8", 2 * blocks).reshape(blocks, 2)
    out = np.empty((blocks, 16, 4), np.uint8)
    out[:] = (0, 0, 0, 255)
    low = (words[:, 0] & np.uint64(255)).astype(np.int64)
    for mode in range(8):
        own = np.flatnonzero(low & ((2 << mode) - 1) == 1 << mode)
        if len(own):
            out[own] = _of_mode(mode, words[own])
    return out


def decode_block(block: bytes) -> list[tuple[int, int, int, int]]:
    return [tuple(px) for px in decode(block, 1)[0].tolist()]
