"""BC7 and BC6H in vectors, against one block and one bit at a time."""

import random
import time

import numpy as np
import pytest

from imagelake.sources import bc6h, bc7


def plain_bc7(block):
    word, at = int.from_bytes(block, "little"), 0

    def take(n):
        nonlocal at
        at += n
        return word >> (at - n) & ((1 << n) - 1)

    mode = next((m for m in range(8) if word >> m & 1), None)
    if mode is None:
        return [(0, 0, 0, 255)] * 16
    at = mode + 1
    subsets, pb, rb, sb, cb, ab, per_end, per_subset, ib, ib2 = bc7.MODES[mode]
    partition, rotation, selection = take(pb), take(rb), take(sb)
    ends = [[[take(cb), take(cb)] for _ in range(subsets)] for _ in range(3)]
    ends.append([[take(ab), take(ab)] if ab else [255, 255] for _ in range(subsets)])
    extra = [[take(1), take(1)] if per_end else [take(1)] * 2 for _ in range(subsets)] if per_end or per_subset else None
    for c, bits in enumerate((cb, cb, cb, ab)):
        for s in range(subsets if bits else 0):
            for e in range(2):
                v, n = (ends[c][s][e] << 1 | extra[s][e], bits + 1) if extra else (ends[c][s][e], bits)
                ends[c][s][e] = v << (8 - n) | v >> (2 * n - 8)
    first = [take(ib - (t in bc7.anchors_of(subsets, partition))) for t in range(16)]
    second = [take(ib2 - (t == 0)) for t in range(16)] if ib2 else first
    assert at == 128
    out = []
    for t in range(16):
        pair = [(first[t], ib), (second[t], ib2 or ib)]
        colour, alpha = pair[::-1] if selection else pair
        s = bc7.subset_of(subsets, partition, t)
        px = []
        for c in range(4):
            k, n = alpha if c == 3 else colour
            w = bc7.WEIGHTS[n][k]
            px.append((64 - w) * ends[c][s][0] + w * ends[c][s][1] + 32 >> 6)
        if rotation:
            px[3], px[rotation - 1] = px[rotation - 1], px[3]
        out.append(tuple(px))
    return out


def plain_bc6h(block, signed):
    word = int.from_bytes(block, "little")
    mode, at = (word & 3, 2) if word & 3 < 2 else (word & 31, 5)
    if mode not in bc6h.MODES:
        return [(0, 0, 0)] * 16
    first, others, delta, _ = bc6h.MODES[mode]
    fields = {}
    for name, bit in bc6h.LAYOUTS[mode]:
        fields[name] = fields.get(name, 0) | (word >> at & 1) << bit
        at += 1
    extended = lambda v, n: v - (1 << n) if v >> (n - 1) & 1 else v

    def whole(v):
        if not signed:
            return v if first >= 15 or v == 0 else 0xFFFF if v == (1 << first) - 1 else ((v << 16) + 0x8000) >> first
        v = extended(v, first)
        m = abs(v)
        m = m if first >= 16 or not m else 0x7FFF if m >= (1 << (first - 1)) - 1 else ((m << 15) + 0x4000) >> (first - 1)
        return -m if v < 0 else m

    subsets, partition = 2 if "d" in fields else 1, fields.get("d", 0)
    ends = []
    for name in "wxyz"[: 2 * subsets]:
        ends.append([whole(fields[c + "w"] + extended(fields[c + name], n) & (1 << first) - 1 if delta and name != "w" else fields[c + name]) for c, n in zip("rgb", others, strict=True)])
    size, out = 3 if subsets == 2 else 4, []
    for t in range(16):
        n = size - (t in bc7.anchors_of(subsets, partition))
        w = bc7.WEIGHTS[size][word >> at & (1 << n) - 1]
        at += n
        s = bc7.subset_of(subsets, partition, t)
        px = []
        for a, b in zip(ends[2 * s], ends[2 * s + 1], strict=True):
            v = (a * (64 - w) + b * w + 32) >> 6
            px.append(v * 31 >> 6 if not signed else (m := abs(v) * 31 >> 5) | (0x8000 if v < 0 and m else 0))
        out.append(tuple(px))
    assert at == 128
    return out


def test_bc7_blocks_of_every_mode():
    r = random.Random(1)
    blocks = [bytes([(r.randrange(256) >> (m + 1) << (m + 1) | 1 << m) & 255]) + r.randbytes(15) for m in range(8) for _ in range(400)] + [bytes(16)]
    r.shuffle(blocks)
    assert [list(map(tuple, b)) for b in bc7.decode(b"".join(blocks), len(blocks)).tolist()] == [plain_bc7(b) for b in blocks]
    assert bc7.decode(b"", 0).shape == (0, 16, 4)


@pytest.mark.parametrize("signed", [False, True])
def test_bc6h_blocks_of_every_mode(signed):
    r = random.Random(2)
    blocks = []
    for mode in [*bc6h.MODES, 19, 23, 27, 31]:
        n = 2 if mode < 2 else 5
        blocks += [bytes([r.randrange(256) >> n << n | mode]) + r.randbytes(15) for _ in range(200)]
    r.shuffle(blocks)
    assert [list(map(tuple, b)) for b in bc6h.decoded(b"".join(blocks), len(blocks), signed).tolist()] == [plain_bc6h(b, signed) for b in blocks]
    assert bc6h.decode(b"", 0).shape == (0, 16, 3)


def test_blocks_are_decoded_in_vectors():
    """A block takes some microseconds, not a hundred, whatever the modes."""
    raw = np.random.default_rng(1).integers(0, 256, 16 * 40_000).astype(np.uint8).tobytes()
    for decode in (bc7.decode, bc6h.decode):
        began = time.process_time()
        decode(raw, 40_000)
        assert time.process_time() - began < 40_000 * 30e-6
