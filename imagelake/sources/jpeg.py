"""JPEG: baseline and progressive, decoding and encoding; 8 bits, one or three components."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np

from imagelake.operators.dct import LUMA, scaled_table, zigzag
from imagelake.sources.base import FormatError, Image, Limits

# The example chroma table and the example Huffman tables of the standard.
CHROMA = (17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99)
CHROMA = tuple(CHROMA[y * 4 + x] if y < 4 and x < 4 else 99 for y in range(8) for x in range(8))
_ZIG = np.array(zigzag())
_C = np.array([[(math.sqrt(0.125) if k == 0 else 0.5) * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)])


#: Samples that a byte can stand for at most: every block takes one bit of a scan at least, and there are 64 samples in
#: it, or 256 pixels of a halved component.
MOST_PER_BYTE = 8 * 256 * 3


class Table:
    """A canonical Huffman code."""

    def __init__(self, counts, symbols):
        self.counts, self.symbols, self.codes, self.lookup = tuple(counts), tuple(symbols), {}, {}
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[symbols[k]] = (code, length)
                self.lookup[length, code] = symbols[k]
                code, k = code + 1, k + 1
            if code > 1 << length:
                raise FormatError("jpeg", "BadHuffman", "over-subscribed")
            code <<= 1
        # By the next 9 bits: (symbol, length) of the code that they begin with, if it is no longer.
        self.short: list[tuple[int, int] | None] = [None] * 512
        for (length, code), s in self.lookup.items():
            if length <= 9:
                span = 1 << (9 - length)
                self.short[code * span : (code + 1) * span] = [(s, length)] * span


def optimal(counts: dict[int, int]) -> Table:
    """Lengths of at most 16 by repeated merging and the usual adjustment; the all-ones code stays unused."""
    weights = [(n, s) for s, n in counts.items() if n] + [(1, 256)]
    length = {s: 0 for _, s in weights}
    groups = sorted((n, [s]) for n, s in weights)
    while len(groups) > 1:
        (a, x), (b, y), *groups = groups
        for s in x + y:
            length[s] += 1
        groups = sorted([*groups, (a + b, x + y)], key=lambda g: (g[0], -max(g[1])))
    bits = [0] * (max(max(length.values()), 16) + 1)
    for n in length.values():
        bits[n] += 1
    for i in range(len(bits) - 1, 16, -1):
        while bits[i] > 0:
            j = i - 2
            while not bits[j]:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    last = max(i for i in range(17) if bits[i])
    bits[last] -= 1
    order = sorted((s for s in length if s != 256), key=lambda s: (length[s], -counts[s], s))
    return Table(bits[1:17], order)


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.word, self.n = (self.word << 8 | byte) & 0xFFFFFFFFFF, self.n + 8
            if self.at > len(self.data) + 8:
                raise FormatError("jpeg", "TruncatedScan")

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.n -= n
        return self.word >> self.n & ((1 << n) - 1)

    def symbol(self, table: Table) -> int:
        if self.n < 9:
            self.need(9)
        found = table.short[self.word >> (self.n - 9) & 511]
        if found is not None:
            self.n -= found[1]
            return found[0]
        code, lookup = self.take(9), table.lookup
        for length in range(10, 17):
            code = code << 1 | self.take(1)
            s = lookup.get((length, code))
            if s is not None:
                return s
        raise FormatError("jpeg", "BadCode")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class _Component:
    def __init__(self, name, h, v, q):
        self.name, self.h, self.v, self.q = name, h, v, q


def _segments(data: bytes):
    """(marker, payload, entropy-coded parts after it)."""
    if data[:2] != b"\xff\xd8":
        raise FormatError("jpeg", "BadSignature", "", 0)
    at = 2
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise FormatError("jpeg", "BadMarker", "", at)
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            return
        (n,) = struct.unpack(">H", data[at : at + 2]) if at + 2 <= len(data) else (0,)
        if n < 2 or at + n > len(data):
            raise FormatError("jpeg", "TruncatedSegment", hex(marker), at)
        payload, at, parts = data[at + 2 : at + n], at + n, []
        if marker == 0xDA:
            start = at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise FormatError("jpeg", "MissingEnd", "", start)
                if data[at + 1] == 0:
                    at += 2
                elif 0xD0 <= data[at + 1] <= 0xD7:
                    parts.append(data[start:at])
                    at += 2
                    start = at
                else:
                    break
            parts.append(data[start:at])
            parts = [p.replace(b"\xff\0", b"\xff") for p in parts]
        yield marker, payload, parts


def _scan(frame: dict, parts: list[bytes], comps: list, restart: int, spec: tuple[int, int, int, int], dc: dict, ac: dict) -> None:
    first, last, high, low = spec
    hmax, vmax = frame["hmax"], frame["vmax"]
    if len(comps) == 1:
        c = comps[0][0]
        bw, bh = -(-(-(-frame["w"] * c.h // hmax)) // 8), -(-(-(-frame["h"] * c.v // vmax)) // 8)
        units = [[(c, comps[0], y, x)] for y in range(bh) for x in range(bw)]
    else:
        units = [[(s[0], s, my * s[0].v + j, mx * s[0].h + i) for s in comps for j in range(s[0].v) for i in range(s[0].h)] for my in range(frame["my"]) for mx in range(frame["mx"])]
    step = restart or len(units)
    for k in range(0, len(units), step):
        if k // step >= len(parts):
            raise FormatError("jpeg", "MissingRestart")
        bits, previous, eob = Bits(parts[k // step]), {}, 0
        for unit in units[k : k + step]:
            for c, (_, td, ta), y, x in unit:
                block = c.blocks[y, x]
                if first == 0:
                    if high == 0:
                        previous[c.name] = previous.get(c.name, 0) + bits.signed(bits.symbol(dc[td]))
                        block[0] = previous[c.name] << low
                    elif bits.take(1):
                        block[0] |= 1 << low
                if last == 0:
                    continue
                i = max(first, 1)
                if high == 0:
                    if eob:
                        eob -= 1
                        continue
                    while i <= last:
                        s = bits.symbol(ac[ta])
                        run, size = s >> 4, s & 15
                        if size:
                            i += run
                            if i > 63:
                                raise FormatError("jpeg", "BadCoefficient")
                            block[i] = bits.signed(size) * (1 << low)
                            i += 1
                        elif run == 15:
                            i += 16
                        else:
                            eob = (1 << run) - 1 + bits.take(run)
                            break
                else:
                    eob = _refine(bits, block, i, last, low, ac[ta], eob)


def _refine(bits: Bits, block: np.ndarray, i: int, last: int, low: int, table: Table, eob: int) -> int:
    bit = 1 << low

    def correct(k: int) -> None:
        if bits.take(1) and not abs(int(block[k])) & bit:
            block[k] += bit if block[k] > 0 else -bit

    if not eob:
        while i <= last:
            s = bits.symbol(table)
            run, size = s >> 4, s & 15
            value = 0
            if size:
                if size != 1:
                    raise FormatError("jpeg", "BadRefinement")
                value = bit if bits.take(1) else -bit
            elif run < 15:
                eob = (1 << run) + bits.take(run)
                break
            while i <= last:
                if block[i]:
                    correct(i)
                elif run == 0:
                    if value:
                        block[i] = value
                    i += 1
                    break
                else:
                    run -= 1
                i += 1
            else:
                if value or run:
                    raise FormatError("jpeg", "BadRefinement", "a run leaves the spectral band")
    if eob:
        while i <= last:
            if block[i]:
                correct(i)
            i += 1
        eob -= 1
    return eob


def decode(data: bytes, limits: Limits = Limits(), interpolate: bool = True) -> Image:
    quant, dc, ac, frame, restart, raw_rgb, metadata = {}, {}, {}, None, 0, False, []
    for marker, p, parts in _segments(data):
        if marker == 0xDB:
            at = 0
            while at < len(p):
                wide, k = p[at] >> 4, p[at] & 15
                n = 128 if wide else 64
                if at + 1 + n > len(p):
                    raise FormatError("jpeg", "TruncatedSegment", "DQT")
                table = np.zeros(64)
                table[_ZIG] = np.frombuffer(p, ">u2" if wide else np.uint8, 64, at + 1)
                quant[k] = table
                at += 1 + n
        elif marker == 0xC4:
            at = 0
            while at < len(p):
                counts = p[at + 1 : at + 17]
                n = sum(counts)
                (ac if p[at] >> 4 else dc)[p[at] & 15] = Table(counts, p[at + 17 : at + 17 + n])
                at += 17 + n
        elif marker in (0xC0, 0xC1, 0xC2):
            depth, h, w, n = struct.unpack(">BHHB", p[:6])
            if depth != 8 or n not in (1, 3) or not h or not w or frame:
                raise FormatError("jpeg", "Unsupported.Jpeg.Frame", f"{depth} bits, {n} components")
            limits.check(w, h, n)
            if w * h * n > MOST_PER_BYTE * len(data) + (1 << 20):
                raise FormatError("jpeg", "LimitExceeded", f"{w} x {h} in {len(data)} bytes")
            comps = [_Component(p[6 + 3 * i], p[7 + 3 * i] >> 4, p[7 + 3 * i] & 15, p[8 + 3 * i]) for i in range(n)]
            if any(not 1 <= v <= 4 for c in comps for v in (c.h, c.v)):
                raise FormatError("jpeg", "BadSampling")
            hmax, vmax = max(c.h for c in comps), max(c.v for c in comps)
            frame = {"w": w, "h": h, "comps": comps, "hmax": hmax, "vmax": vmax, "mx": -(-w // (8 * hmax)), "my": -(-h // (8 * vmax)), "progressive": marker == 0xC2}
            for c in comps:
                c.blocks = np.zeros((frame["my"] * c.v, frame["mx"] * c.h, 64), np.int32)
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
            raise FormatError("jpeg", "Unsupported.Jpeg.Process", hex(marker))
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", p)
        elif marker == 0xEE and p[:5] == b"Adobe" and len(p) >= 12:
            raw_rgb = p[11] == 0
        elif marker == 0xFE:
            metadata.append(("jpeg", "comment", p))
        elif 0xE0 <= marker <= 0xEF:
            metadata.append(("jpeg", f"app{marker & 15}", p))
        elif marker == 0xDA:
            if not frame:
                raise FormatError("jpeg", "BadOrder", "scan before frame")
            n = p[0]
            if len(p) < 4 + 2 * n or not n:
                raise FormatError("jpeg", "TruncatedSegment", "SOS")
            named = {c.name: c for c in frame["comps"]}
            if any(p[1 + 2 * i] not in named for i in range(n)):
                raise FormatError("jpeg", "BadComponent", "a scan names a component that the frame hasn't")
            chosen = [(named[p[1 + 2 * i]], p[2 + 2 * i] >> 4, p[2 + 2 * i] & 15) for i in range(n)]
            first, last, approx = p[1 + 2 * n : 4 + 2 * n]
            spec = (first, last, approx >> 4, approx & 15) if frame["progressive"] else (0, 63, 0, 0)
            if spec[0] > spec[1] or spec[1] > 63 or (frame["progressive"] and spec[0] == 0 and spec[1]):
                raise FormatError("jpeg", "BadScan", str(spec))
            try:
                _scan(frame, parts, chosen, restart, spec, dc, ac)
            except KeyError as e:
                raise FormatError("jpeg", "MissingTable", str(e)) from e
    if not frame:
        raise FormatError("jpeg", "MissingFrame")
    planes = []
    for c in frame["comps"]:
        if c.q not in quant:
            raise FormatError("jpeg", "MissingTable", f"quantisation {c.q}")
        natural = np.zeros(c.blocks.shape)
        natural[:, :, _ZIG] = c.blocks
        pixels = _C.T @ (natural * quant[c.q]).reshape(*c.blocks.shape[:2], 8, 8) @ _C + 128
        plane = np.clip(np.rint(pixels), 0, 255).swapaxes(1, 2).reshape(c.blocks.shape[0] * 8, c.blocks.shape[1] * 8)
        fx, fy = frame["hmax"] // c.h, frame["vmax"] // c.v
        w, h = -(-frame["w"] * c.h // frame["hmax"]), -(-frame["h"] * c.v // frame["vmax"])
        planes.append(_upsample(_upsample(plane[:h, :w], fy, 0, interpolate), fx, 1, interpolate)[: frame["h"], : frame["w"]])
    if len(planes) == 1:
        return Image("jpeg", ["Y"], "unorm8", planes[0].astype(np.uint8)[:, :, None], metadata=metadata)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = planes if raw_rgb else (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)
    return Image("jpeg", ["R", "G", "B"], "unorm8", np.clip(np.rint(np.stack(rgb, 2)), 0, 255).astype(np.uint8), metadata=metadata)


def _upsample(plane: np.ndarray, factor: int, axis: int, smooth: bool) -> np.ndarray:
    if factor == 1:
        return plane
    out = np.repeat(plane, factor, axis)
    if factor != 2 or not smooth:
        return out
    p = np.moveaxis(plane, axis, 0)
    before, after = np.concatenate((p[:1], p[:-1])), np.concatenate((p[1:], p[-1:]))
    mixed = np.empty((2 * len(p), *p.shape[1:]))
    mixed[0::2], mixed[1::2] = (3 * p + before) / 4, (3 * p + after) / 4
    return np.moveaxis(mixed, 0, axis)


# ---------------------------------------------------------------- encoding


def _tokens(blocks: np.ndarray, previous: int) -> list[tuple[int, int, int, int]]:
    """(class, symbol, value, bits) of one block in zig-zag order; class 0 DC, 1 AC."""
    size = lambda v: abs(v).bit_length()
    low = lambda v, n: v if v >= 0 else v + (1 << n) - 1
    d = int(blocks[0]) - previous
    out = [(0, size(d), low(d, size(d)), size(d))]
    run, last = 0, int(np.max(np.flatnonzero(blocks), initial=0))
    for v in map(int, blocks[1 : last + 1]):
        if not v:
            run += 1
            continue
        while run > 15:
            out.append((1, 0xF0, 0, 0))
            run -= 16
        out.append((1, run << 4 | size(v), low(v, size(v)), size(v)))
        run = 0
    if last < 63:
        out.append((1, 0, 0, 0))
    return out


def restart_interval(units: int, nonzero: int, segments: int) -> int:
    """Units between restart markers, 0 for none: at least 4 units and 8,192 nonzero coefficients a segment, and no more
    than `segments` of them. A parameter, not the machine's cores, decides, so that files don't depend on the machine."""
    if units <= 4:
        return 0
    n = min(units // 4, segments, max(1, nonzero // 8192))
    return 0 if n <= 1 else -(-units // n)


def _spectra(image: Image, subsampling: str) -> tuple[list[np.ndarray], tuple[int, int], tuple[int, int]]:
    """Cosine coefficients of each component (blocks down, across, 64), by rows; the luma's factors; units across and down."""
    if image.sample != "unorm8" or image.samples.shape[2] not in (1, 3):
        raise FormatError("jpeg", "Unsupported.Jpeg.Samples", image.sample)
    h, w, n = image.samples.shape
    v = image.samples.astype(np.float64)
    hs, vs = {"444": (1, 1), "422": (2, 1), "420": (2, 2)}[subsampling] if n == 3 else (1, 1)
    padded = np.pad(v, ((0, -h % (8 * vs)), (0, -w % (8 * hs)), (0, 0)), mode="edge")
    if n == 1:
        planes = [padded[:, :, 0] - 128]
    else:
        r, g, b = np.moveaxis(padded, 2, 0)
        chroma = [c.reshape(c.shape[0] // vs, vs, c.shape[1] // hs, hs).mean((1, 3)) for c in (-0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b)]
        planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, *chroma]
    blocks = [p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2) for p in planes]
    return [(_C @ b @ _C.T).reshape(*b.shape[:2], 64) for b in blocks], (hs, vs), (padded.shape[1] // (8 * hs), padded.shape[0] // (8 * vs))


def _tables(quality: int, n: int) -> list[np.ndarray]:
    return [np.array(scaled_table(quality, t)) for t in ((LUMA, CHROMA) if n == 3 else (LUMA,))]


def _quantised(spectrum: np.ndarray, table: np.ndarray) -> np.ndarray:
    """In zig-zag order."""
    return np.rint(spectrum / table).astype(np.int64)[..., _ZIG]


#: Coefficients whose sizes are bounded at once.
_BOUNDED = 1 << 15


def least_sizes(image: Image, qualities: Sequence[int], subsampling: str = "420", progressive: bool = False, restart: int | None = 0) -> Iterator[int]:
    """For each quality, bytes that encode()'s file has at least: all but those stuffed after 0xFF, with codes as short as
    the symbols' entropy allows. 0, which bounds nothing, with several scans or restart markers."""
    if progressive or restart != 0:
        yield from (0 for _ in qualities)
        return
    spectra, factors, (across, down) = _spectra(image, subsampling)
    n = len(spectra)
    # Blocks in the order of the scan, which the differences of DC follow.
    ordered = [c.reshape(down, fv, across, fh, 64).swapaxes(1, 2).reshape(-1, 64) for c, (fh, fv) in zip(spectra, (factors, (1, 1), (1, 1)))]
    comments = sum(4 + len(value) for space, key, value in image.metadata if (space, key) == ("jpeg", "comment"))
    fixed = 2 + 18 + comments + 69 * min(n, 2) + 10 + 3 * n + 8 + 2 * n + 2
    step = max(1, _BOUNDED // sum(c.size for c in ordered))
    for some in (qualities[i : i + step] for i in range(0, len(qualities), step)):
        tables, m = [_tables(q, n) for q in some], len(some)
        counts, bits = np.zeros((m, 2, 2, 256)), np.zeros(m)
        at = np.arange(m)[:, None] * 256
        for k, c in enumerate(ordered):
            kind = min(k, 1)
            v = _quantised(c[None], np.stack([t[kind] for t in tables])[:, None])
            size = np.frexp(np.concatenate((np.diff(v[:, :, :1], axis=1, prepend=0), v[:, :, 1:]), 2))[1]
            bits += size.sum((1, 2))
            tally = lambda where, weights=None: np.bincount(where.ravel(), weights, m * 256).reshape(m, 256)
            counts[:, kind, 0] += tally(at + size[:, :, 0])
            q, block, place = np.nonzero(v[:, :, 1:])
            first = np.diff(q * v.shape[1] + block, prepend=-1) != 0
            run = np.where(first, place, np.diff(place, prepend=0) - 1)
            counts[:, kind, 1] += tally(q * 256 + ((run & 15) << 4 | size[q, block, place + 1]))
            counts[:, kind, 1, 0xF0] += np.bincount(q, run >> 4, m)
            counts[:, kind, 1, 0] += (v[:, :, 63] == 0).sum(1)
        total = counts.sum(3, keepdims=True)
        shares = np.divide(total, counts, out=np.ones_like(counts), where=counts > 0)
        coded = np.maximum((counts * np.log2(shares)).sum(3), total[..., 0])  # a code has a bit at least
        heads = (21 * (total[..., 0] > 0) + (counts > 0).sum(3)).sum((1, 2))
        yield from (fixed + heads + np.ceil((bits + coded.sum((1, 2))) / 8 - 1e-6)).astype(np.int64).tolist()


def encode(image: Image, quality: int = 90, subsampling: str = "420", progressive: bool = False, restart: int | None = 0, segments: int = 16) -> bytes:
    """Baseline, or progressive by spectral selection; Huffman tables are fitted to the image. restart: units between
    restart markers of a baseline scan, None to choose by restart_interval."""
    if not 1 <= quality <= 100 or subsampling not in ("444", "422", "420"):
        raise FormatError("jpeg", "BadOption", f"{quality} {subsampling}")
    h, w, n = image.samples.shape
    spectra, (hs, vs), (across, down) = _spectra(image, subsampling)
    tables = _tables(quality, n)
    coded = [_quantised(c, tables[min(k, 1)]) for k, c in enumerate(spectra)]
    factors = [(hs, vs), (1, 1), (1, 1)][:n]
    seg = lambda m, p: b"\xff" + bytes([m]) + struct.pack(">H", len(p) + 2) + p
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(seg(0xFE, value) for space, key, value in image.metadata if (space, key) == ("jpeg", "comment"))
    for k, t in enumerate(tables):
        out += seg(0xDB, bytes([k]) + bytes(t[_ZIG].tolist()))
    frame = struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes((k + 1, fh << 4 | fv, min(k, 1))) for k, (fh, fv) in enumerate(factors))
    out += seg(0xC2 if progressive else 0xC0, frame)
    if restart is None:
        restart = restart_interval(across * down, int(sum(np.count_nonzero(c) for c in coded)), segments)
    if progressive:
        restart = 0
    if restart:
        out += seg(0xDD, struct.pack(">H", restart))
    stream, previous, resets = [], [0] * n, []  # (table, class, symbol, value, bits) of all components, in the order of a shared scan
    for my in range(down):
        for mx in range(across):
            if restart and my * across + mx and (my * across + mx) % restart == 0:
                resets.append(len(stream))
                previous = [0] * n
            for k, (fh, fv) in enumerate(factors):
                for j in range(fv):
                    for i in range(fh):
                        block = coded[k][my * fv + j, mx * fh + i]
                        tokens = _tokens(block, previous[k])
                        stream += [(min(k, 1), *t) for t in (tokens[:1] if progressive else tokens)]
                        previous[k] = int(block[0])
    out += _scan_bytes(stream, list(range(n)), (0, 0 if progressive else 63), resets)
    for k in range(n if progressive else 0):  # then the other coefficients of each component in a scan of its own
        fh, fv = factors[k]
        bw, bh = -(-(-(-w * fh // hs)) // 8), -(-(-(-h * fv // vs)) // 8)
        stream = [(min(k, 1), *t) for y in range(bh) for x in range(bw) for t in _tokens(coded[k][y, x], 0)[1:]]
        out += _scan_bytes(stream, [k], (1, 63))
    return out + b"\xff\xd9"


def _scan_bytes(stream: list[tuple], components: list[int], band: tuple[int, int], resets: list[int] = ()) -> bytes:
    """Huffman tables fitted to the tokens, the scan's header, and its packed bits, with restart markers before the tokens
    at `resets`."""
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for k, kind, symbol, _, _ in stream:
        seen = counts.setdefault((kind, k), {})
        seen[symbol] = seen.get(symbol, 0) + 1
    huff = {key: optimal(c) for key, c in counts.items()}
    word = used = 0
    packed = bytearray()
    marks = dict(zip(resets, range(len(resets))))
    for at, (k, kind, symbol, value, bits) in enumerate(stream):
        if at in marks:
            if used:
                byte = (word << (8 - used) | (1 << (8 - used)) - 1) & 255
                packed += bytes((byte, 0)) if byte == 255 else bytes((byte,))
            packed += bytes((255, 0xD0 + marks[at] % 8))
            word = used = 0
        code, length = huff[kind, k].codes[symbol]
        word, used = (word << length | code) << bits | value, used + length + bits
        while used >= 8:
            byte = word >> (used - 8) & 255
            packed.append(byte)
            if byte == 255:
                packed.append(0)
            used -= 8
        word &= (1 << used) - 1
    if used:
        byte = (word << (8 - used) | (1 << (8 - used)) - 1) & 255
        packed += bytes((byte, 0)) if byte == 255 else bytes((byte,))
    seg = lambda m, p: b"\xff" + bytes([m]) + struct.pack(">H", len(p) + 2) + p
    out = b"".join(seg(0xC4, bytes([kind << 4 | k]) + bytes(t.counts) + bytes(t.symbols)) for (kind, k), t in sorted(huff.items()))
    chosen = b"".join(bytes((k + 1, min(k, 1) * 0x11)) for k in components)
    return out + seg(0xDA, bytes([len(components)]) + chosen + bytes((*band, 0))) + bytes(packed)
