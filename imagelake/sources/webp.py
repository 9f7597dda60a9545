"""WebP: the container, lossless images, and lossy ones where the tables of their format are given (see vp8.py).
Animations are recognised but not decoded."""

from __future__ import annotations

import struct

import numpy as np

from imagelake.sources import vp8, vp8lgroups
from imagelake.sources.base import Budget, FormatError, Image, Limits

# The order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distances in the order of their codes: nearest first.
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)
)
MASK = 0xFFFFFFFF


def chunks(data: bytes) -> list[tuple[str, bytes]]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise FormatError("webp", "BadSignature", "", 0)
    (size,) = struct.unpack("<I", data[4:8])
    if size + 8 > len(data) or size < 12:
        raise FormatError("webp", "TruncatedFile", str(size), 4)
    out, at = [], 12
    while at + 8 <= size + 8:
        kind, n = data[at : at + 4].decode("latin-1"), struct.unpack("<I", data[at + 4 : at + 8])[0]
        if at + 8 + n > size + 8:
            raise FormatError("webp", "TruncatedChunk", kind, at)
        out.append((kind, data[at + 8 : at + 8 + n]))
        at += 8 + n + n % 2
    return out


class _Bits:
    """Least significant bit first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise FormatError("webp", "TruncatedData", "", self.at)
            self.word |= self.data[self.at] << self.n
            self.at, self.n = self.at + 1, self.n + 8
        out = self.word & ((1 << n) - 1)
        self.word >>= n
        self.n -= n
        return out

    def peek(self, n: int) -> int:
        """The next bits, zeros beyond the end."""
        if self.n < n:
            part = self.data[self.at : self.at + 8]
            self.word |= int.from_bytes(part, "little") << self.n
            self.at, self.n = self.at + len(part), self.n + 8 * len(part)
        return self.word & ((1 << n) - 1)


class _Code:
    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.single = used[0][1] if len(used) == 1 else None
        self.lookup: dict[tuple[int, int], int] = {}
        code = last = space = 0
        for n, s in sorted(used):
            code <<= n - last
            self.lookup[n, code] = s
            code, last, space = code + 1, n, space + (1 << (15 - n))
        if not used or (self.single is None and space != 1 << 15):
            raise FormatError("webp", "BadHuffman", "incomplete code")
        # By the next 8 bits: (symbol, length) of the code that they begin with, if it is no longer.
        self.short: list[tuple[int, int] | None] = [None] * 256
        for (n, code), s in self.lookup.items():
            if n <= 8:
                for k in range(int(f"{code:0{n}b}"[::-1], 2), 256, 1 << n):
                    self.short[k] = (s, n)

    def read(self, bits: _Bits) -> int:
        if self.single is not None:
            return self.single
        found = self.short[bits.peek(8)]
        if found is not None:
            bits.take(found[1])
            return found[0]
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.take(1)
            s = self.lookup.get((n, code))
            if s is not None:
                return s
        raise FormatError("webp", "BadCode")


def _read_code(bits: _Bits, size: int) -> _Code:
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)] + ([bits.take(8)] if two else [])
        if max(symbols) >= size:
            raise FormatError("webp", "BadHuffman", "symbol")
        return _Code([1 if s in symbols else 0 for s in range(size)])
    lengths = [0] * 19
    for k in range(bits.take(4) + 4):
        lengths[LENGTH_ORDER[k]] = bits.take(3)
    code = _Code(lengths)
    most = bits.take(2 + 2 * bits.take(3)) + 2 if bits.take(1) else size
    out, previous = [], 8
    while len(out) < size and most:
        most -= 1
        s = code.read(bits)
        if s < 16:
            out.append(s)
            previous = s or previous
        else:
            n = {16: lambda: 3 + bits.take(2), 17: lambda: 3 + bits.take(3), 18: lambda: 11 + bits.take(7)}[s]()
            out += [previous if s == 16 else 0] * n
    if len(out) > size:
        raise FormatError("webp", "BadHuffman", "lengths")
    return _Code(out + [0] * (size - len(out)))


def _prefix(bits: _Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _entropy_image(bits: _Bits, w: int, h: int, top: bool) -> np.ndarray:
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise FormatError("webp", "BadCache")
    meta, shift, groups = None, 0, 1
    if top and bits.take(1):
        shift = bits.take(3) + 2
        meta = _entropy_image(bits, (w + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift, False)
        meta = meta >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    out, cache, n, total = np.zeros(w * h, np.int64), [0] * (1 << cache_bits), 0, w * h
    filled = 0

    def remember(upto: int) -> None:
        nonlocal filled
        while filled < upto:
            p = int(out[filled])
            cache[(p * 0x1E35A7BD & MASK) >> (32 - cache_bits)] = p
            filled += 1

    while n < total:
        group = codes[int(meta[n // w >> shift, n % w >> shift])] if meta is not None else codes[0]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = (group[k].read(bits) for k in (1, 2, 3))
            out[n] = a << 24 | r << 16 | s << 8 | b
            n += 1
        elif s < 280:
            length = _prefix(bits, s - 256)
            back = _distance(_prefix(bits, group[4].read(bits)), w)
            if back > n or n + length > total:
                raise FormatError("webp", "BadReference")
            for k in range(length):
                out[n + k] = out[n + k - back]
            n += length
        else:
            remember(n)
            out[n] = cache[s - 280]
            n += 1
    return out.reshape(h, w)


def _split(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> k & 255 for k in (24, 16, 8, 0)], -1)


def _predicted(mode: int, left, top, right, corner):
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = half(left, top)
        d = m - corner
        return np.clip(m + (np.abs(d) // 2) * np.sign(d), 0, 255)
    return (
        np.array([255, 0, 0, 0]), left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top),
        half(corner, top), half(top, right), half(half(left, corner), half(top, right)),
    )[mode] if mode <= 10 else np.array([255, 0, 0, 0])


def _along(mode: int, row: list[int], above: list[int], first: int, last: int) -> None:
    """Undoes a prediction that looks to the left, for one channel of a row's part."""
    for x in range(first, last):
        left, top, corner = row[x - 1], above[x], above[x - 1]
        if mode == 1:
            p = left
        elif mode == 5:
            p = (((left + above[x + 1]) >> 1) + top) >> 1
        elif mode == 6:
            p = (left + corner) >> 1
        elif mode == 7:
            p = (left + top) >> 1
        elif mode == 10:
            p = (((left + corner) >> 1) + ((top + above[x + 1]) >> 1)) >> 1
        elif mode == 12:
            p = min(255, max(0, left + top - corner))
        else:
            m = (left + top) >> 1
            d = m - corner
            p = min(255, max(0, m + (d // 2 if d >= 0 else -(-d // 2))))
        row[x] = (row[x] + p) & 255


def _unpredict(px: np.ndarray, modes: np.ndarray, bits: int) -> None:
    """Rows in order. What a mode takes from the row above is added at once; what it takes from the left, step by step."""
    h, w, _ = px.shape
    px[0, 0] = (px[0, 0] + [255, 0, 0, 0]) & 255
    px[0] = np.cumsum(px[0], axis=0) & 255
    for y in range(1, h):
        px[y, 0] = (px[y, 0] + px[y - 1, 0]) & 255
        above = np.concatenate((px[y - 1], px[y, :1]))  # to the right of the last pixel stands the row's first one
        for at in range(0, w, 1 << bits):
            mode, first, last = int(modes[y >> bits, at >> bits]), max(1, at), min(w, at + (1 << bits))
            if first >= last:
                continue
            top, corner, right = above[first:last], above[first - 1 : last - 1], above[first + 1 : last + 1]
            if mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                p = {2: top, 3: right, 4: corner, 8: (corner + top) >> 1, 9: (top + right) >> 1}.get(mode, np.array([255, 0, 0, 0]))
                px[y, first:last] = (px[y, first:last] + p) & 255
            elif mode == 11:
                row, over = px[y, first - 1 : last].tolist(), above[first - 1 : last].tolist()
                for k in range(1, len(row)):
                    left, here, back = row[k - 1], over[k], over[k - 1]
                    to_left = sum(abs(a - b) for a, b in zip(here, back))
                    to_top = sum(abs(a - b) for a, b in zip(left, back))
                    row[k] = [(v + p) & 255 for v, p in zip(row[k], left if to_left < to_top else here)]
                px[y, first:last] = row[1:]
            else:
                for c in range(4):
                    row, over = px[y, first - 1 : last, c].tolist(), above[first - 1 : last + 1, c].tolist()
                    _along(mode, row, over, 1, len(row))
                    px[y, first:last, c] = row[1:]


def _signed(v: np.ndarray) -> np.ndarray:
    return np.where(v > 127, v - 256, v)


def decode_lossless(data: bytes, limits: Limits) -> np.ndarray:
    """(height, width, ARGB)."""
    bits = _Bits(data)
    if bits.take(8) != 0x2F:
        raise FormatError("webp", "BadLosslessSignature")
    w, h = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise FormatError("webp", "Unsupported.Webp.Version")
    limits.check(w, h)
    budget = Budget("webp", limits.working_bytes)
    budget.reserve(w * h * 40)  # packed pixels, and four channels of 64 bits
    transforms, width = [], w
    while bits.take(1):
        kind = bits.take(2)
        if kind in [t[0] for t in transforms]:
            raise FormatError("webp", "DuplicateTransform", str(kind))
        if kind in (0, 1):
            shift = bits.take(3) + 2
            transforms.append((kind, shift, _entropy_image(bits, (width + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift, False), width))
        elif kind == 2:
            transforms.append((kind, 0, None, width))
        else:
            n = bits.take(8) + 1
            table = np.cumsum(_split(_entropy_image(bits, n, 1, False))[0], axis=0) & 255
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, packing, table, width))
            width = (width + (1 << packing) - 1) >> packing
    px = _split(_entropy_image(bits, width, h, True))
    for kind, shift, extra, width in reversed(transforms):
        if kind == 0:
            _unpredict(px, _split(extra)[:, :, 2] & 15, shift)
        elif kind == 1:
            e = _signed(_split(extra))
            e = np.repeat(np.repeat(e, 1 << shift, 0), 1 << shift, 1)[:h, :width]
            green = _signed(px[:, :, 2])
            red = (px[:, :, 1] + (e[:, :, 3] * green >> 5)) & 255
            blue = px[:, :, 3] + (e[:, :, 2] * green >> 5) + (e[:, :, 1] * _signed(red) >> 5)
            px[:, :, 1], px[:, :, 3] = red, blue & 255
        elif kind == 2:
            px[:, :, 1] = (px[:, :, 1] + px[:, :, 2]) & 255
            px[:, :, 3] = (px[:, :, 3] + px[:, :, 2]) & 255
        else:
            index = px[:, :, 2]
            if shift:
                per = 8 >> shift
                index = np.stack([index >> per * k & (1 << per) - 1 for k in range(1 << shift)], -1).reshape(h, -1)[:, :width]
            table = np.concatenate((extra, np.zeros((256 - len(extra), 4), extra.dtype)))
            px = table[index]
    return px


def alpha_plane(chunk: bytes, width: int, height: int, limits: Limits = Limits()) -> np.ndarray:
    """The alpha of a lossy image from its chunk: raw or lossless bytes, then the inverse of one of four filters."""
    if not chunk:
        raise FormatError("webp", "BadAlpha", "empty")
    packing, kind, preprocessing = chunk[0] & 3, chunk[0] >> 2 & 3, chunk[0] >> 4
    if packing > 1 or preprocessing > 1:
        raise FormatError("webp", "BadAlpha", f"header {chunk[0]}")
    limits.check(width, height, 1)
    if packing:  # a lossless stream without its header; alpha stands in green
        head = _Writer()
        for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4)):
            head.put(value, n)
        out = decode_lossless(head.done() + chunk[1:], limits)[:, :, 2].astype(np.uint8)
    else:
        if len(chunk) - 1 < width * height:
            raise FormatError("webp", "BadAlpha", "truncated")
        out = np.frombuffer(chunk, np.uint8, width * height, 1).reshape(height, width).copy()
    if kind == 0:
        return out
    out[0] = np.cumsum(out[0], dtype=np.uint8)
    out[:, 0] = np.cumsum(out[:, 0], dtype=np.uint8)
    if kind == 1:
        return np.cumsum(out, axis=1, dtype=np.uint8) if height == 1 else np.concatenate((out[:1], np.cumsum(out[1:], axis=1, dtype=np.uint8)))
    if kind == 2:
        return np.concatenate((out[:, :1], np.cumsum(out[:, 1:], axis=0, dtype=np.uint8)), axis=1)
    for y in range(1, height):
        row, above = out[y].tolist(), out[y - 1].tolist()
        for x in range(1, width):
            row[x] = row[x] + min(255, max(0, row[x - 1] + above[x] - above[x - 1])) & 255
        out[y] = row
    return out


def decode(data: bytes, limits: Limits = Limits(), tables: vp8.Tables | None = None) -> Image:
    parts = chunks(data)
    kinds = [k for k, _ in parts]
    metadata = [("webp", k, v) for k, v in parts if k in ("ICCP", "EXIF", "XMP ")]
    if "ANIM" in kinds or "ANMF" in kinds:
        raise FormatError("webp", "Unsupported.Webp.Animation")
    if kinds.count("VP8L") + kinds.count("VP8 ") != 1:
        raise FormatError("webp", "MissingImage", ",".join(kinds))
    if "VP8 " in kinds:
        if tables is None:
            raise FormatError("webp", "Unsupported.Webp.Lossy", "lossy frames need the tables of RFC 6386")
        rgb = vp8.decode(dict(parts)["VP8 "], limits, tables)
        h, w, _ = rgb.shape
        alpha = alpha_plane(dict(parts)["ALPH"], w, h, limits) if "ALPH" in kinds else np.full((h, w), 255, np.uint8)
        px = np.concatenate((alpha[:, :, None], rgb), 2)
    else:
        px = decode_lossless(dict(parts)["VP8L"], limits)
    if "VP8X" in kinds:
        head = dict(parts)["VP8X"]
        size = int.from_bytes(head[4:7], "little") + 1, int.from_bytes(head[7:10], "little") + 1
        if size != (px.shape[1], px.shape[0]):
            raise FormatError("webp", "BadCanvas", str(size))
    return Image("webp", list("RGBA"), "unorm8", px[:, :, [1, 2, 3, 0]].astype(np.uint8), metadata=metadata)


# ---------------------------------------------------------------- encoding


class _Writer:
    def __init__(self):
        self.out, self.word, self.n = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.word |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.word & 255)
            self.word >>= 8
            self.n -= 8

    def done(self) -> bytes:
        return bytes(self.out) + (bytes([self.word & 255]) if self.n else b"")


def _lengths(counts: dict[int, int], longest: int) -> dict[int, int]:
    """Huffman lengths of at most `longest`, by flattening the counts until they fit."""
    import heapq

    floor = 1
    while True:
        heap = [(max(n, floor), [s]) for s, n in sorted(counts.items())]
        heapq.heapify(heap)
        length = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                length[s] += 1
            heapq.heappush(heap, (a + b, x + y))
        if max(length.values()) <= longest:
            return length
        floor *= 2


def _canonical(length: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits in writing order, length)."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in length.items() if n):
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def _folded(listed: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra bits, their value): 16 repeats the last one 3 to 6 times, 17 and 18 are zeros."""
    out, at = [], 0
    while at < len(listed):
        n, run = listed[at], 1
        while at + run < len(listed) and listed[at + run] == n:
            run += 1
        at += run
        if n:
            out.append((n, 0, 0))
            run -= 1
        kinds = ((16, 3, 6, 2),) if n else ((18, 11, 138, 7), (17, 3, 10, 3))
        while run:
            symbol, least, most, extra = next((k for k in kinds if run >= k[1]), (n, 1, 1, 0))
            took = min(run, most)
            out.append((symbol, extra, took - least))
            run -= took
    return out


def _write_code(w: _Writer, counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    used = sorted(counts) or [0]
    if len(used) <= 2 and max(used) < 256:
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return {s: (k, len(used) - 1) for k, s in enumerate(used)}
    if len(used) == 1:  # a single symbol beyond 255 needs a partner
        counts = counts | {0: 1}
    length = _lengths(counts, 15)
    listed = _folded([length.get(s, 0) for s in range(size)])
    symbols = [s for s, _, _ in listed]
    small = _lengths({s: symbols.count(s) for s in set(symbols)} | ({} if len(set(symbols)) > 1 else {0: 1}), 7)
    w.put(0, 1)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if small.get(s)) + 1
    w.put(max(last, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(last, 4)]:
        w.put(small.get(s, 0), 3)
    w.put(0, 1)
    codes = _canonical(small)
    for s, extra, rest in listed:
        w.put(*codes[s])
        w.put(rest, extra)
    return _canonical(length)


def _prefix_of(v: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their value) of a length or distance code."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), extra, v & (1 << extra) - 1


def _tokens(argb: list[int], width: int, reach: list[tuple[int, int]]) -> list:
    """Pixels, and (length, distance code) where at least three repeat what stands at one of the distances in `reach`."""
    codes = {max(1, x + y * width): NEAR.index((x, y)) + 1 for x, y in reversed(reach)}
    out, at, total = [], 0, len(argb)
    while at < total:
        best = back = 0
        for d in codes:
            k = 0
            while d <= at and at + k < total and k < 4096 and argb[at + k] == argb[at + k - d]:
                k += 1
            if k > best:
                best, back = k, d
        out.append((best, codes[back]) if best >= 3 else argb[at])
        at += best if best >= 3 else 1
    return out


def _put_image(out: _Writer, argb: np.ndarray, top: bool, reach: list[tuple[int, int]]) -> None:
    """An entropy-coded image without a colour cache and with one group of codes."""
    tokens = _tokens(argb.ravel().tolist(), argb.shape[1], reach)
    counts: list[dict[int, int]] = [{}, {}, {}, {}, {}]
    bump = lambda k, s: counts[k].__setitem__(s, counts[k].get(s, 0) + 1)
    for t in tokens:
        if isinstance(t, tuple):
            bump(0, 256 + _prefix_of(t[0])[0])
            bump(4, _prefix_of(t[1])[0])
        else:
            for k, s in enumerate((t >> 8 & 255, t >> 16 & 255, t & 255, t >> 24)):
                bump(k, s)
    out.put(0, 1)  # no cache
    if top:
        out.put(0, 1)  # one group
    made = [_write_code(out, c, size) for c, size in zip(counts, (280, 256, 256, 256, 40), strict=True)]
    for t in tokens:
        if isinstance(t, tuple):
            for k, base, value in ((0, 256, t[0]), (4, 0, t[1])):
                s, extra, rest = _prefix_of(value)
                out.put(*made[k][base + s])
                out.put(rest, extra)
        else:
            for k, s in enumerate((t >> 8 & 255, t >> 16 & 255, t & 255, t >> 24)):
                out.put(*made[k][s])


def _put_grouped(out: _Writer, argb: np.ndarray, reach: list[tuple[int, int]]) -> None:
    """An entropy-coded image with copies from anywhere, and the cache and the groups of codes that pay."""
    h, w = argb.shape
    codes = {max(1, x + y * w): NEAR.index((x, y)) + 1 for x, y in reversed(reach)}
    t = vp8lgroups.tokens(argb.ravel(), codes)
    shift = vp8lgroups.tile_shift(w, h)
    meta = vp8lgroups.grouped(t, w, h, shift)
    groups = int(meta.max()) + 1
    out.put(int(t.cache > 0), 1)
    if t.cache:
        out.put(t.cache, 4)
    out.put(int(groups > 1), 1)
    if groups > 1:
        out.put(shift - 2, 3)
        _put_image(out, 255 << 24 | meta.astype(np.int64) << 8, False, reach[:1])
    of = meta[t.start // w >> shift, t.start % w >> shift]
    made = []
    for g in range(groups):
        mine = t.symbols[:, of == g]
        counts = [np.unique(s[s >= 0], return_counts=True) for s in mine]
        made.append([_write_code(out, dict(zip(*(c.tolist() for c in pair), strict=True)), size) for pair, size in zip(counts, t.sizes, strict=True)])
    for g, symbols, extra, value in zip(of.tolist(), t.symbols.T.tolist(), t.extra.T.tolist(), t.value.T.tolist(), strict=True):
        for k, s in enumerate(symbols):
            if s >= 0:
                out.put(*made[g][k][s])
                out.put(value[k], extra[k])


def _packed(px: np.ndarray) -> np.ndarray:
    px = px.astype(np.int64)
    return px[..., 0] << 24 | px[..., 1] << 16 | px[..., 2] << 8 | px[..., 3]


def _guesses(px: np.ndarray, modes: tuple[int, ...]) -> np.ndarray:
    """What each mode predicts for each pixel, (modes, height, width, ARGB); the first row and column have rules of their own."""
    left, top, corner = np.zeros_like(px), np.zeros_like(px), np.zeros_like(px)
    left[:, 1:], top[1:], corner[1:, 1:] = px[:, :-1], px[:-1], px[:-1, :-1]
    right = np.zeros_like(px)
    right[1:, :-1], right[1:, -1] = px[:-1, 1:], px[1:, 0]
    half = lambda a, b: (a + b) >> 1
    made = []
    for mode in modes:
        if mode == 11:
            near = np.abs(top - corner).sum(-1) < np.abs(left - corner).sum(-1)
            g = np.where(near[..., None], left, top)
        elif mode in (12, 13):
            g = _predicted(mode, left, top, right, corner)
        elif mode == 0:
            g = np.broadcast_to(np.array([255, 0, 0, 0]), px.shape)
        else:
            g = (None, left, top, right, corner, half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right)))[mode]
        g = g.copy()
        g[0, 1:], g[1:, 0], g[0, 0] = left[0, 1:], top[1:, 0], (255, 0, 0, 0)
        made.append(g)
    return np.stack(made)


def _cost(residual: np.ndarray) -> float:
    """Bits by the entropy of each channel."""
    total = 0.0
    for c in range(4):
        n = np.bincount(residual[..., c].ravel(), minlength=256)
        n = n[n > 0]
        total += float((n * np.log2(n.sum() / n)).sum())
    return total


#: Plans by effort: (subtract green, prediction: none, one mode for all tiles, or the best of a tile; palette; distances;
#: whether codes are grouped by tile, with a colour cache and copies from anywhere).
_LEFT, _NEAREST = [(1, 0), (0, 1)], [(1, 0), (0, 1), (1, 1), (-1, 1), (2, 0), (0, 2), (3, 0), (4, 0)]
PLANS = {
    "fast": ((True, None, False, _LEFT, False),),
    "balanced": ((True, None, False, _LEFT, False), (True, "one", False, _LEFT, False), (False, None, True, _LEFT, False)),
    "best": (
        (True, None, False, _NEAREST, False), (False, None, False, _NEAREST, False), (True, "one", False, _NEAREST, False), (True, "tiles", False, _NEAREST, False),
        (False, "tiles", False, _NEAREST, False), (False, None, True, _NEAREST, False),
        (False, None, False, _NEAREST, True), (True, None, False, _NEAREST, True), (True, "tiles", False, _NEAREST, True), (False, None, True, _NEAREST, True),
    ),
}
_TILE = 4  # log2 of the tile's side


def _planned(px: np.ndarray, alpha: bool, green: bool, prediction: str | None, palette: bool, reach: list[tuple[int, int]], grouped: bool) -> bytes | None:
    h, w, _ = px.shape
    out = _Writer()
    out.put(0x2F, 8)
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)
    if palette:
        table, index = np.unique(_packed(px), return_inverse=True)
        n = len(table)
        if n > 256:
            return None
        packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        out.put(1, 1)
        out.put(3, 2)
        out.put(n - 1, 8)
        steps = _split(table)
        steps[1:] = (steps[1:] - steps[:-1]) & 255
        _put_image(out, _packed(steps)[None, :], False, reach[:1])
        index, per = index.reshape(h, w), 8 >> packing
        index = np.pad(index, ((0, 0), (0, -w % (1 << packing)))).reshape(h, -1, 1 << packing)
        index = (index << (per * np.arange(1 << packing))).sum(-1)
        px = np.zeros((*index.shape, 4), np.int64)
        px[..., 0], px[..., 2] = 255, index
    if green:
        out.put(1, 1)
        out.put(2, 2)
        px = px.copy()
        px[..., 1], px[..., 3] = (px[..., 1] - px[..., 2]) & 255, (px[..., 3] - px[..., 2]) & 255
    if prediction:
        modes = tuple(range(14)) if prediction == "tiles" else (1, 2, 7, 11, 12)
        residuals = (px[None] - _guesses(px, modes)) & 255
        rows, columns = -(-h // (1 << _TILE)), -(-w // (1 << _TILE))
        if prediction == "one":
            chosen = np.full((rows, columns), min(range(len(modes)), key=lambda k: _cost(residuals[k])))
        else:
            far = np.minimum(residuals, 256 - residuals).sum(-1)
            far = np.pad(far, ((0, 0), (0, -h % (1 << _TILE)), (0, -w % (1 << _TILE))))
            chosen = far.reshape(len(modes), rows, 1 << _TILE, columns, 1 << _TILE).sum((2, 4)).argmin(0)
        out.put(1, 1)
        out.put(0, 2)
        out.put(_TILE - 2, 3)
        _put_image(out, 255 << 24 | np.array(modes)[chosen] << 8, False, reach[:1])
        each = np.repeat(np.repeat(chosen, 1 << _TILE, 0), 1 << _TILE, 1)[:h, :w]
        px = np.take_along_axis(residuals, each[None, :, :, None], 0)[0]
    out.put(0, 1)
    if grouped:
        _put_grouped(out, _packed(px), reach)
    else:
        _put_image(out, _packed(px), True, reach)
    return out.done()


#: Prediction modes that a lossy encoder tries.
LOSSY_MODES = {"fast": 1, "balanced": 2, "best": 4}


def _container(parts: list[tuple[bytes, bytes]]) -> bytes:
    body = b"".join(kind + struct.pack("<I", len(data)) + data + bytes(len(data) % 2) for kind, data in parts)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def encode(image: Image, effort: str = "balanced", lossless: bool = True, quality: int = 75, tables: vp8.Tables | None = None) -> bytes:
    """Lossless: the smallest result of the effort's plans; more effort never gives a larger file than less. Lossy: colour by
    quality, alpha whole."""
    if image.sample != "unorm8" or image.samples.shape[2] not in (3, 4):
        raise FormatError("webp", "Unsupported.Webp.Samples", f"{image.sample} {image.samples.shape[2]}")
    if effort not in PLANS:
        raise FormatError("webp", "BadOption", effort)
    h, w, n = image.samples.shape
    if max(h, w) > 16384:
        raise FormatError("webp", "LimitExceeded", f"{w} x {h}")
    if not lossless:
        if tables is None:
            raise FormatError("webp", "Unsupported.Webp.Lossy", "lossy frames need the tables of RFC 6386")
        frame = b"VP8 ", vp8.encode(image.samples[:, :, :3], quality, tables, LOSSY_MODES[effort])
        if n == 3 or (image.samples[:, :, 3] == 255).all():
            return _container([frame])
        canvas = bytes([16, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
        return _container([(b"VP8X", canvas), (b"ALPH", b"\0" + image.samples[:, :, 3].astype(np.uint8).tobytes()), frame])
    px = np.full((h, w, 4), 255, np.int64)
    px[:, :, 1:] = image.samples[:, :, :3]
    if n == 4:
        px[:, :, 0] = image.samples[:, :, 3]
    alpha = bool((px[:, :, 0] != 255).any())
    tried = [p for e in list(PLANS)[: list(PLANS).index(effort) + 1] for p in PLANS[e]]
    body = min((b for p in tried if (b := _planned(px, alpha, *p)) is not None), key=len)
    return _container([(b"VP8L", body)])
