"""Packed pixels and BC1-BC5 blocks as numpy kernels, a whole image at a time."""

from __future__ import annotations

import numpy as np

from imagelake.functions.packed import FIELDS
from imagelake.sources import bc6h, bc7
from imagelake.sources.base import FormatError

SIZES = {"bc1": 8, "bc2": 16, "bc3": 16, "bc4": 8, "bc5": 16, "bc6h": 16, "bc6h_signed": 16, "bc7": 16}

# ---------------------------------------------------------------- packed pixels


def _small_float(bits: np.ndarray, n: int) -> np.ndarray:
    return (bits.astype(np.uint16) << (10 - n)).astype("<u2").view("<f2").astype(np.float32)


def unpack(kind: str, raw: bytes) -> np.ndarray:
    """(pixels, channels) of float32, channels in the order R, G, B, A."""
    word = np.frombuffer(raw, "<u2" if kind.startswith("b5") else "<u4").astype(np.uint32)
    part = {c: (word >> at) & ((1 << n) - 1) for c, at, n in FIELDS[kind]}
    bits = {c: n for c, _, n in FIELDS[kind]}
    if kind == "rgb9e5":
        scale = np.ldexp(1.0, part["e"].astype(np.int32) - 24)
        return np.stack([part[c] * scale for c in "rgb"], -1).astype(np.float32)
    if kind == "r11g11b10f":
        return np.stack([_small_float(part[c], bits[c] - 5) for c in "rgb"], -1)
    return np.stack([part[c] * np.float32(1 / ((1 << bits[c]) - 1)) for c in "rgba" if c in part], -1).astype(np.float32)


def _small_bits(v: np.ndarray, n: int) -> np.ndarray:
    m = np.minimum(np.maximum(np.nan_to_num(v.astype(np.float64), nan=0.0, posinf=131072.0), 0), 131072.0)
    _, e = np.frexp(np.where(m > 0, m, 1.0))
    e = np.maximum(e - 1, -14)
    bits = np.rint(m / np.ldexp(1.0, e - n)).astype(np.int64) + (e + 14) * (1 << n)
    bits = np.minimum(np.where(m == 0, 0, bits), 31 << n)
    return np.where(np.isnan(v), (31 << n) | (1 << (n - 1)), bits)


def pack(kind: str, samples: np.ndarray) -> bytes:
    v = samples.reshape(-1, samples.shape[-1]).astype(np.float64)
    if kind == "rgb9e5":
        v = np.clip(np.nan_to_num(v, nan=0.0), 0, 65408.0)
        top = v.max(1)
        _, e = np.frexp(np.where(top > 0, top, 2.0**-16))
        e = np.maximum(e - 1, -16) + 16
        e = np.where(np.floor(top / np.ldexp(1.0, e - 24) + 0.5) == 512, e + 1, e)
        m = np.floor(v / np.ldexp(1.0, e - 24)[:, None] + 0.5).astype(np.int64)
        word = m[:, 0] | m[:, 1] << 9 | m[:, 2] << 18 | e.astype(np.int64) << 27
    elif kind == "r11g11b10f":
        word = sum(_small_bits(v[:, i], n - 5) << at for i, (_, at, n) in enumerate(FIELDS[kind]))
    else:
        order = "rgba"
        clean = np.clip(np.nan_to_num(v, nan=0.0), 0, 1)
        word = sum(np.floor(clean[:, order.index(c)] * ((1 << n) - 1) + 0.5).astype(np.int64) << at for c, at, n in FIELDS[kind])
    return word.astype("<u2" if kind.startswith("b5") else "<u4").tobytes()


# ---------------------------------------------------------------- blocks


def to_blocks(image: np.ndarray) -> np.ndarray:
    """(blocks, 16, channels); edge blocks repeat the last row and column."""
    h, w, c = image.shape
    padded = np.pad(image, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")
    return padded.reshape(padded.shape[0] // 4, 4, padded.shape[1] // 4, 4, c).swapaxes(1, 2).reshape(-1, 16, c)


def from_blocks(blocks: np.ndarray, w: int, h: int) -> np.ndarray:
    rows, columns = -(-h // 4), -(-w // 4)
    out = blocks.reshape(rows, columns, 4, 4, -1).swapaxes(1, 2).reshape(rows * 4, columns * 4, -1)
    return out[:h, :w]


def _rgb565(word: np.ndarray) -> np.ndarray:
    r, g, b = word >> 11, word >> 5 & 63, word & 31
    return np.stack((r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2), -1)


def _color_palette(c0: np.ndarray, c1: np.ndarray, always_four: bool) -> np.ndarray:
    """(blocks, 4, RGBA)."""
    a, b = _rgb565(c0), _rgb565(c1)
    four = ((c0 > c1) | always_four)[:, None]
    third = np.where(four, (2 * a + b) // 3, (a + b) // 2)
    fourth = np.where(four, (a + 2 * b) // 3, 0)
    colors = np.stack((a, b, third, fourth), 1)
    alpha = np.full((len(c0), 4, 1), 255)
    alpha[:, 3, 0] = np.where(four[:, 0], 255, 0)
    return np.concatenate((colors, alpha), 2)


def _decode_color(raw: np.ndarray, always_four: bool) -> np.ndarray:
    head = raw[:, :4].copy().view("<u2").astype(np.int32)
    index = raw[:, 4:8].copy().view("<u4")
    palette = _color_palette(head[:, 0], head[:, 1], always_four)
    picks = (index >> (2 * np.arange(16, dtype=np.uint32))) & 3
    return np.take_along_axis(palette, picks.astype(np.int64)[:, :, None], 1)


def _alpha_palette(v0: np.ndarray, v1: np.ndarray) -> np.ndarray:
    v0, v1 = v0.astype(np.int32), v1.astype(np.int32)
    six = [v0, v1] + [((7 - i) * v0 + i * v1) // 7 for i in range(1, 7)]
    four = [v0, v1] + [((5 - i) * v0 + i * v1) // 5 for i in range(1, 5)] + [0 * v0, 0 * v0 + 255]
    return np.where((v0 > v1)[:, None], np.stack(six, 1), np.stack(four, 1))


def _decode_single(raw: np.ndarray) -> np.ndarray:
    word = np.zeros((len(raw), 8), np.uint8)
    word[:, :6] = raw[:, 2:8]
    picks = (word.view("<u8") >> (3 * np.arange(16, dtype=np.uint64))) & np.uint64(7)
    return np.take_along_axis(_alpha_palette(raw[:, 0], raw[:, 1]), picks.astype(np.int64), 1)


def decode_texels(kind: str, raw: bytes, n: int) -> np.ndarray:
    """(blocks, 16, channels)."""
    if kind == "bc7":
        return bc7.decode(raw, n)
    if kind.startswith("bc6h"):
        return bc6h.decode(raw, n, kind.endswith("signed"))
    b = np.frombuffer(raw, np.uint8, n * SIZES[kind]).reshape(n, SIZES[kind])
    if kind == "bc1":
        out = _decode_color(b, False)
    elif kind == "bc2":
        out = _decode_color(b[:, 8:], True).copy()
        nibbles = np.stack((b[:, :8] & 15, b[:, :8] >> 4), 2).reshape(n, 16)
        out[:, :, 3] = nibbles.astype(np.int32) * 17
    elif kind == "bc3":
        out = _decode_color(b[:, 8:], True).copy()
        out[:, :, 3] = _decode_single(b[:, :8])
    elif kind == "bc4":
        out = _decode_single(b)[:, :, None]
    else:
        out = np.stack((_decode_single(b[:, :8]), _decode_single(b[:, 8:])), 2)
    return out


def decode_image(kind: str, raw: bytes, w: int, h: int) -> np.ndarray:
    n = -(-w // 4) * -(-h // 4)
    out = from_blocks(decode_texels(kind, raw, n), w, h)
    return out if kind.startswith("bc6h") else out.astype(np.uint8)


_PAIRS = [(i, j) for i in range(16) for j in range(i + 1, 16)]


def _encode_color(t: np.ndarray, opaque: bool) -> np.ndarray:
    rgb = t[:, :, :3].astype(np.int32)
    i, j = np.array(_PAIRS).T
    d = ((rgb[:, i] - rgb[:, j]) ** 2).sum(2)
    far = d.argmax(1)  # the first of the farthest
    rows = np.arange(len(rgb))
    word = lambda c: (c[:, 0] >> 3) << 11 | (c[:, 1] >> 2) << 5 | c[:, 2] >> 3
    a, b = word(rgb[rows, i[far]]), word(rgb[rows, j[far]])
    c0, c1 = np.maximum(a, b), np.minimum(a, b)
    if opaque:
        same = c0 == c1
        c1 = np.where(same & (c0 == 0xFFFF), c1 - 1, c1)
        c0 = np.where(same & (c0 != 0xFFFF), c0 + 1, c0)
    palette = _color_palette(c0, c1, False)[:, :, :3]
    picks = ((rgb[:, :, None] - palette[:, None]) ** 2).sum(3).argmin(2).astype(np.uint32)
    index = (picks << (2 * np.arange(16, dtype=np.uint32))).sum(1, dtype=np.uint32)
    return np.concatenate((np.stack((c0, c1), 1).astype("<u2").view(np.uint8).reshape(-1, 4), index.astype("<u4")[:, None].view(np.uint8)), 1)


def _encode_single(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int32)
    high, low = v.max(1), v.min(1)
    palette = _alpha_palette(high, low)
    picks = np.abs(v[:, :, None] - palette[:, None]).argmin(2).astype(np.uint64)
    word = (picks << (3 * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
    return np.concatenate((np.stack((high, low), 1).astype(np.uint8), word.astype("<u8")[:, None].view(np.uint8)[:, :6]), 1)


def encode_texels(kind: str, t: np.ndarray) -> bytes:
    """Bytes of (blocks, 16, channels), one block after the other."""
    if kind == "bc7" or kind.startswith("bc6h"):
        raise FormatError("texture", "Unsupported.Encoding", f"{kind} is decoded only")
    if kind == "bc1":
        out = _encode_color(t, False)
    elif kind == "bc2":
        code = np.minimum(15, (t[:, :, 3].astype(np.int32) + 8) // 17).astype(np.uint8)
        out = np.concatenate((code[:, 0::2] | code[:, 1::2] << 4, _encode_color(t, True)), 1)
    elif kind == "bc3":
        out = np.concatenate((_encode_single(t[:, :, 3]), _encode_color(t, True)), 1)
    elif kind == "bc4":
        out = _encode_single(t[:, :, 0])
    else:
        out = np.concatenate((_encode_single(t[:, :, 0]), _encode_single(t[:, :, 1])), 1)
    return np.ascontiguousarray(out).tobytes()


def encode_image(kind: str, image: np.ndarray) -> bytes:
    return encode_texels(kind, to_blocks(image.astype(np.uint8)))
