"""Richer entropy images of lossless WebP: copies from any distance, a colour cache, and tiles grouped by their codes.

A token is a pixel, a cached colour or a copy. Everything about pixels is computed for all of them at once; only the walk
from token to token is a loop."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Longest copy, and the least number of pixels that a copy from anywhere must save.
LONGEST, LEAST_NEAR, LEAST_FAR = 4096, 3, 4
#: Colour caches that are weighed against none, as powers of two, and group counts that are weighed against one.
CACHES, COUNTS = (4, 6, 8, 10), (2, 3, 4, 6, 8, 12, 16)
#: Tiles of an image whose histograms are held at a time; larger images have larger tiles.
TILES = 2048
_HASH = 0x1E35A7BD  # fixed value: the format's hash of a colour


def prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, numbers of extra bits, their values) of length or distance codes from 1."""
    v = v.astype(np.int64) - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    small, extra = v < 4, np.maximum(top - 1, 0)
    return np.where(small, v, 2 * top + (v >> extra & 1)), np.where(small, 0, extra), np.where(small, 0, v & ((1 << extra) - 1))


def _repeats(flat: np.ndarray, back: int) -> np.ndarray:
    """How many pixels from each place on equal those `back` before them."""
    n = len(flat)
    place, same = np.arange(n), np.zeros(n, bool)
    same[back:] = flat[back:] == flat[: max(n - back, 0)]
    return np.minimum(np.minimum.accumulate(np.where(same, n, place)[::-1])[::-1] - place, LONGEST)


def _latest(keys: np.ndarray) -> np.ndarray:
    """The last place before each one with an equal key, or -1."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def walked(flat: np.ndarray, codes: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance code) of tokens; a pixel has length 1 and code 0. codes: distances that have short codes.
    A copy is the longest of those at these distances and of that from the last place with the same four pixels."""
    n, distances = len(flat), list(codes)
    near = np.stack([_repeats(flat, d) for d in distances])
    which, most = near.argmax(0).tolist(), near.max(0).tolist()
    key = np.zeros(n, np.uint64)
    for k in range(min(LEAST_FAR, n)):
        key[: n - k] = key[: n - k] * np.uint64(0x9E3779B97F4A7C15) + flat[k:].astype(np.uint64) + np.uint64(1)
    before = _latest(key).tolist()
    out, at = [], 0
    while at < n:
        length, code = most[at], codes[distances[which[at]]]
        if length < LEAST_NEAR:
            length = 0
        back = at - before[at]
        if before[at] >= 0 and back not in codes and length < LONGEST:
            span = min(LONGEST, n - at)
            differ = flat[at : at + span] != flat[at - back : at - back + span]
            far = int(differ.argmax()) if differ.any() else span
            if far >= LEAST_FAR and far > length + 1:
                length, code = far, back + 120
        out.append((at, length or 1, code if length else 0))
        at += length or 1
    start, length, code = np.array(out, np.int64).T
    return start, length, code


def cached(flat: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, whether the slot holds the colour) of each pixel, with all pixels before it in the cache."""
    slots = (flat * _HASH & 0xFFFFFFFF) >> (32 - bits)
    last = _latest(slots)
    return slots, (last >= 0) & (flat[last] == flat)


def _bits(counts: np.ndarray) -> np.ndarray:
    """Bits by entropy of each row of counts."""
    total = counts.sum(-1, keepdims=True)
    return (counts * np.log2(np.maximum(total, 1) / np.maximum(counts, 1))).sum(-1)


@dataclass
class Tokens:
    """start, and for each of five alphabets the symbol (or -1), extra bits and their value; in writing order."""

    start: np.ndarray
    symbols: np.ndarray
    extra: np.ndarray
    value: np.ndarray
    cache: int
    sizes: tuple[int, ...]


def tokens(flat: np.ndarray, codes: dict[int, int]) -> Tokens:
    """With the cache, or none, whose symbols take the fewest bits."""
    start, length, code = walked(flat, codes)
    copy, p = code > 0, flat[start]
    made = None
    for bits in (0, *CACHES):
        slots, hit = cached(flat, bits) if bits else (np.zeros(len(flat), np.int64), np.zeros(len(flat), bool))
        hit = hit[start] & ~copy
        symbols = np.stack([np.where(hit, 280 + slots[start], p >> 8 & 255), *(np.where(hit, -1, p >> k & 255) for k in (16, 0, 24)), np.full(len(p), -1)])
        extra, value = np.zeros_like(symbols), np.zeros_like(symbols)
        symbols[1:4, copy] = -1
        if copy.any():
            for row, base, v in ((0, 256, length), (4, 0, code)):
                s, extra[row, copy], value[row, copy] = prefixes(v[copy])
                symbols[row, copy] = base + s
        sizes = 280 + (1 << bits if bits else 0), 256, 256, 256, 40
        counts = [np.bincount(s[s >= 0], minlength=size) for s, size in zip(symbols, sizes, strict=True)]
        cost = sum(float(_bits(c)) + 4 * np.count_nonzero(c) for c in counts)
        if made is None or cost < made[0]:
            made = cost, Tokens(start, symbols, extra, value, bits, sizes)
    return made[1]


def tile_shift(width: int, height: int) -> int:
    """Of the smallest tiles, from 16 pixels on, of which there are at most TILES; the format knows none above 512."""
    return next((s for s in range(4, 9) if -(-width // (1 << s)) * -(-height // (1 << s)) <= TILES), 9)


def _lengths_by(groups: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """Bits of each symbol in each group's codes; symbols that a group lacks count as half."""
    out = np.empty(groups.shape)
    for a, b in edges:
        n = groups[:, a:b]
        out[:, a:b] = np.log2(np.maximum(n.sum(1, keepdims=True), 1) + 0.5) - np.log2(np.maximum(n, 0.5))
    return out


def _priced(groups: np.ndarray, of: np.ndarray, edges: list[tuple[int, int]]) -> float:
    """Bits of the data, the groups' codes and the tiles' numbers."""
    data = sum(float(_bits(groups[:, a:b]).sum()) for a, b in edges)
    return data + 5 * np.count_nonzero(groups) + 60 * len(groups) + float(_bits(np.bincount(of)))


def grouped(t: Tokens, width: int, height: int, shift: int) -> np.ndarray:
    """The group of each tile, (rows, columns), numbered from 0 without gaps. Groups start at the tile that its group's
    codes serve worst, and tiles then go to the codes that write them in the fewest bits, until none moves or five times;
    of several counts of groups the cheapest is taken."""
    rows, columns = -(-height >> shift), -(-width >> shift)
    tile = (t.start // width >> shift) * columns + (t.start % width >> shift)
    offsets = np.concatenate(([0], np.cumsum(t.sizes)))
    edges, total = list(zip(offsets[:-1], offsets[1:], strict=True)), int(offsets[-1])
    flat = np.concatenate([(tile * total + s + o)[s >= 0] for s, o in zip(t.symbols, offsets[:-1], strict=True)])
    used, flat_used = np.unique(flat % total, return_inverse=True)  # symbols that no tile has take no room
    hist = np.bincount(flat // total * len(used) + flat_used, minlength=rows * columns * len(used)).reshape(-1, len(used)).astype(np.float64)
    edges = [tuple(np.searchsorted(used, e)) for e in edges]
    summed = lambda of, k: np.stack([hist[of == g].sum(0) for g in range(k)])
    own = sum(_bits(hist[:, a:b]) for a, b in edges)
    of = np.zeros(len(hist), np.int64)
    best, best_cost, seeds = of, _priced(summed(of, 1), of, edges), hist.sum(0, keepdims=True)
    for count in (c for c in COUNTS if c <= len(hist)):
        while len(seeds) < count:
            price = (hist @ _lengths_by(seeds, edges).T).min(1)
            seeds = np.concatenate((seeds, hist[[int((price - own).argmax())]]))
        groups = seeds
        for _ in range(5):
            last, of = of, (hist @ _lengths_by(groups, edges).T).argmin(1)
            _, of = np.unique(of, return_inverse=True)
            groups = summed(of, int(of.max()) + 1)
            if (of == last).all():
                break
        cost = _priced(groups, of, edges)
        if cost < best_cost:
            best, best_cost = of, cost
        elif cost > 1.1 * best_cost:
            break
        seeds = groups
    return best.reshape(rows, columns)
