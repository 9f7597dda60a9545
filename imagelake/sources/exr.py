"""OpenEXR: scan lines and one-level tiles, half, float and uint channels, subsampling; no, run-length, zip and PIZ
compression. Other compressions and deep data are described but not decoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from imagelake.sources import piz
from imagelake.sources.base import FormatError, Image, Limits
from imagelake.sources.metadata import exr_attribute, exr_value

MAGIC = b"\x76\x2f\x31\x01"
# Lines per chunk by compression.
COMPRESSIONS = {0: ("none", 1), 1: ("rle", 1), 2: ("zips", 1), 3: ("zip", 16), 4: ("piz", 32), 5: ("pxr24", 16), 6: ("b44", 32), 7: ("b44a", 32), 8: ("dwaa", 32), 9: ("dwab", 256)}
KINDS = {0: ("uint32", "<u4"), 1: ("float16", "<f2"), 2: ("float32", "<f4")}
REQUIRED = ("channels", "compression", "dataWindow", "displayWindow", "lineOrder", "pixelAspectRatio", "screenWindowCenter", "screenWindowWidth")
#: Attributes that a writer makes itself.
RESERVED = (*REQUIRED, "tiles", "name", "type", "chunkCount")


def _string(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\0", at)
    if end < 0:
        raise FormatError("exr", "TruncatedHeader", "", at)
    return data[at:end].decode("utf-8", "replace"), end + 1


def headers(data: bytes) -> tuple[list[dict], int, int]:
    """Attributes of each part, version flags, and the place of the first offset table."""
    if data[:4] != MAGIC:
        raise FormatError("exr", "BadSignature", "", 0)
    if len(data) < 8:
        raise FormatError("exr", "TruncatedHeader", "", len(data))
    (version,) = struct.unpack("<I", data[4:8])
    if version & 255 != 2:
        raise FormatError("exr", "Unsupported.Exr.Version", hex(version), 4)
    if version & 0x800:
        raise FormatError("exr", "Unsupported.Exr.Deep", "deep data is described only", 4)
    parts, at = [], 8
    while True:
        attributes = {}
        while True:
            name, at = _string(data, at)
            if not name:
                break
            kind, at = _string(data, at)
            n = int.from_bytes(data[at : at + 4], "little")
            if at + 4 + n > len(data):
                raise FormatError("exr", "TruncatedHeader", name, at)
            if name in attributes:
                raise FormatError("exr", "DuplicateAttribute", name, at)
            attributes[name] = (kind, data[at + 4 : at + 4 + n])
            at += 4 + n
        if not attributes and parts:
            return parts, version, at
        for name in (*REQUIRED, *(("name", "type", "chunkCount") if version & 0x1000 else ())):
            if name not in attributes:
                raise FormatError("exr", "MissingAttribute", name)
        (aspect,) = struct.unpack("<f", attributes["pixelAspectRatio"][1])
        if not 1e-6 <= aspect <= 1e6:
            raise FormatError("exr", "BadAspect", str(aspect))
        parts.append(attributes)
        if not version & 0x1000:
            return parts, version, at


def channels_of(raw: bytes) -> list[tuple[str, int, int, int]]:
    out, at = [], 0
    while raw[at : at + 1] != b"\0":
        name, at = _string(raw, at)
        kind, linear, sx, sy = struct.unpack("<IB3xII", raw[at : at + 16])
        if kind not in KINDS or linear > 1 or not sx or not sy or any(name == c[0] for c in out):
            raise FormatError("exr", "BadChannel", name)
        out.append((name, kind, sx, sy))
        at += 16
    return out


def _undo(raw: bytes) -> bytes:
    """Running sum less 128 a step, then the two halves back into turns."""
    d = np.frombuffer(raw, np.uint8).astype(np.int64)
    d[1:] -= 128
    t = np.cumsum(d).astype(np.uint8)
    out, half = np.empty_like(t), (len(t) + 1) // 2
    out[0::2], out[1::2] = t[:half], t[half:]
    return out.tobytes()


def _predict(raw: bytes) -> bytes:
    a = np.frombuffer(raw, np.uint8)
    t = np.concatenate((a[0::2], a[1::2])).astype(np.int16)
    t[1:] = t[1:] - t[:-1] + 128
    return (t & 255).astype(np.uint8).tobytes()


def _unrle(raw: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at] - 256 if raw[at] > 127 else raw[at]
        if n < 0:
            out += raw[at + 1 : at + 1 - n]
            at += 1 - n
        else:
            out += raw[at + 1 : at + 2] * (n + 1)
            at += 2
        if len(out) > size:
            raise FormatError("exr", "BadRun", "beyond the chunk")
    return bytes(out)


def _rle(raw: bytes) -> bytes:
    """Runs from three up to 128; literals up to 127."""
    out, i, start, n = bytearray(), 0, 0, len(raw)

    def literals(a: int, b: int) -> None:
        for k in range(a, b, 127):
            part = raw[k : min(b, k + 127)]
            out.append(256 - len(part))
            out.extend(part)

    while i < n:
        j = i
        while j < n and j - i < 128 and raw[j] == raw[i]:
            j += 1
        if j - i >= 3:
            literals(start, i)
            out.extend((j - i - 1, raw[i]))
            start = j
        i = j
    literals(start, n)
    return bytes(out)


def decompress(kind: str, raw: bytes, size: int) -> bytes:
    if len(raw) == size or kind == "none":
        out = raw
    elif kind in ("zip", "zips"):
        out = _undo(zlib.decompressobj().decompress(raw, size + 1))
    elif kind == "rle":
        out = _undo(_unrle(raw, size))
    else:
        raise FormatError("exr", "Unsupported.Exr.Compression", kind)
    if len(out) != size:
        raise FormatError("exr", "BadChunkSize", f"{len(out)} instead of {size}")
    return out


def _words(rows: list[tuple]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Shapes of the channels in 16-bit words, in order of first rows, and each row's channel."""
    names = list(dict.fromkeys(r[0] for r in rows))
    shapes = [(sum(r[0] == c for r in rows), next(r[4] for r in rows if r[0] == c), next(np.dtype(KINDS[r[1]][1]).itemsize // 2 for r in rows if r[0] == c)) for c in names]
    return shapes, [names.index(r[0]) for r in rows]


def unpiz(raw: bytes, rows: list[tuple]) -> bytes:
    shapes, owner = _words(rows)
    planes, seen, out = piz.planes_of(piz.decompress(raw, shapes), shapes), [0] * len(shapes), []
    for k in owner:
        out.append(planes[k][seen[k]].astype("<u2").tobytes())
        seen[k] += 1
    return b"".join(out)


def make_piz(raw: bytes, rows: list[tuple]) -> bytes:
    shapes, owner = _words(rows)
    parts, at = [[] for _ in shapes], 0
    for k in owner:
        n = 2 * shapes[k][1] * shapes[k][2]
        parts[k].append(raw[at : at + n])
        at += n
    return piz.compress(np.frombuffer(b"".join(b"".join(p) for p in parts), "<u2").astype(np.int64), shapes)


def compress(kind: str, raw: bytes) -> bytes:
    made = {"none": lambda: raw, "zip": lambda: zlib.compress(_predict(raw)), "zips": lambda: zlib.compress(_predict(raw)), "rle": lambda: _rle(_predict(raw))}[kind]()
    return made if len(made) < len(raw) else raw



def levels_of(w: int, h: int, mode: int) -> list[tuple[int, int, int, int]]:
    """(x level, y level, width, height) of a tiled part in the order of its offset table. mode: 0 one level, 1 mips,
    2 rips, plus 16 where extents round up."""
    kind, up = mode & 15, mode >> 4
    count = lambda e: (e - 1).bit_length() + 1 if up else e.bit_length()
    size = lambda e, k: max(1, (e + (1 << k) - 1) >> k if up else e >> k)
    if kind == 0:
        return [(0, 0, w, h)]
    if kind == 1:
        return [(k, k, size(w, k), size(h, k)) for k in range(count(max(w, h)))]
    return [(i, j, size(w, i), size(h, j)) for j in range(count(h)) for i in range(count(w))]


def decode(data: bytes, limits: Limits = Limits()) -> Image:
    """The first part at full size. Those after it stand in `others` by part number, their names and channels in the
    metadata; lower levels stand there by level, a number for mips and (x level, y level) for rips."""
    parts, version, at = headers(data)
    if len(parts) > limits.parts:
        raise FormatError("exr", "LimitExceeded", f"{len(parts)} parts")
    out = None
    for number, attributes in enumerate(parts):
        image, at = _part(data, attributes, version, at, number, limits)
        if out is None:
            out = image
        else:
            out.others |= {(number, *k[1:]): v for k, v in image.others.items()} | {(number, 0, 0, 0): image.samples}
        if version & 0x1000:
            out.metadata.append(("exr.part", attributes["name"][1].decode("utf-8", "replace"), tuple(image.channels)))
    return out


@dataclass(frozen=True)
class Plan:
    """How a part's samples lie in its chunks. levels: those of levels_of; regions: (level, x, y, width, height) of each
    chunk, in the order of the offset table."""

    kind: str
    window: tuple[int, int]
    width: int
    height: int
    channels: tuple[tuple[str, int, int, int], ...]
    tile: tuple[int, int] | None
    mode: int
    levels: tuple
    regions: tuple

    def rows(self, region: tuple) -> list[tuple]:
        """(channel, kind, y, x, count) of each run of samples of a chunk, in the grid of its channel."""
        _, rx, ry, rw, rh = region
        return [(c, k, y // sy, rx // sx, -(-rw // sx)) for y in range(ry, ry + rh) for c, k, sx, sy in self.channels if (self.window[1] + y) % sy == 0]

    def size_of(self, region: tuple) -> int:
        return sum(count * np.dtype(KINDS[k][1]).itemsize for _, k, _, _, count in self.rows(region))


def plan_of(attributes: dict, version: int, limits: Limits) -> Plan:
    tiled = "tiles" in attributes and (version & 0x200 or attributes.get("type", ("", b""))[1] == b"tiledimage")
    kind, lines = COMPRESSIONS.get(attributes["compression"][1][0], (None, 0))
    x0, y0, x1, y1 = struct.unpack("<4i", attributes["dataWindow"][1])
    w, h, channels = x1 - x0 + 1, y1 - y0 + 1, channels_of(attributes["channels"][1])
    if w <= 0 or h <= 0 or not channels or kind is None:
        raise FormatError("exr", "BadHeader", "window, channels or compression")
    limits.check(w, h, 4 * len(channels))
    mode, regions, tile = 0, [], None
    if tiled:
        tw, th, mode = struct.unpack("<IIB", attributes["tiles"][1])
        if mode & 15 > 2 or mode >> 4 > 1 or not tw or not th:
            raise FormatError("exr", "BadHeader", "tiles")
        if mode & 15 and any((sx, sy) != (1, 1) for _, _, sx, sy in channels):
            raise FormatError("exr", "Unsupported.Exr.Levels", "levels of subsampled channels")
        found, tile = levels_of(w, h, mode), (tw, th)
        if max(max(v[:2]) for v in found) >= limits.levels:
            raise FormatError("exr", "LimitExceeded", f"{len(found)} levels")
        for i, j, lw, lh in found:
            regions += [((i, j), tx * tw, ty * th, min(tw, lw - tx * tw), min(th, lh - ty * th)) for ty in range(-(-lh // th)) for tx in range(-(-lw // tw))]
    else:
        found = [(0, 0, w, h)]
        regions = [((0, 0), 0, y, w, min(lines, h - y)) for y in range(0, h, lines)]
    return Plan(kind, (x0, y0), w, h, tuple(channels), tile, mode, tuple(found), tuple(regions))


def chunk_rows(data: bytes, place: int, plan: Plan, number: int, multi: bool, region: tuple) -> Iterator[tuple[str, int, int, int, np.ndarray]]:
    """(channel, y, x, step, samples) of each run of a chunk's samples, in pixels of its level; the chunk stands at `place`
    of data, which needn't be the whole file."""
    level, rx, ry, _, _ = region
    lead = (20 if plan.tile else 8) + 4 * multi
    if place < 0 or place + lead > len(data):
        raise FormatError("exr", "BadChunkOffset", str(place))
    if multi and struct.unpack("<i", data[place : place + 4])[0] != number:
        raise FormatError("exr", "BadChunkLeader", f"part {number}", place)
    if not plan.tile and struct.unpack("<i", data[place + 4 * multi : place + 4 * multi + 4])[0] != plan.window[1] + ry:
        raise FormatError("exr", "BadChunkLeader", f"row {ry}", place)
    if plan.tile and struct.unpack("<4i", data[place + 4 * multi : place + 4 * multi + 16]) != (rx // plan.tile[0], ry // plan.tile[1], *level):
        raise FormatError("exr", "BadChunkLeader", f"tile at {rx}, {ry} of level {level}", place)
    (n,) = struct.unpack("<I", data[place + lead - 4 : place + lead])
    rows, size = plan.rows(region), plan.size_of(region)
    if n > size or place + lead + n > len(data):
        raise FormatError("exr", "BadChunkSize", str(n), place)
    body, used = data[place + lead : place + lead + n], 0
    raw = unpiz(body, rows) if plan.kind == "piz" and n < size else decompress("none" if plan.kind == "piz" else plan.kind, body, size)
    steps = {c: (sx, sy) for c, _, sx, sy in plan.channels}
    for c, k, y, x, count in rows:
        sx, sy = steps[c]
        yield c, y * sy, x * sx, sx, np.frombuffer(raw, KINDS[k][1], count, used)
        used += count * np.dtype(KINDS[k][1]).itemsize


def _part(data: bytes, attributes: dict, version: int, at: int, number: int, limits: Limits) -> tuple[Image, int]:
    """One part, and where the offset table of the next one begins."""
    plan = plan_of(attributes, version, limits)
    (x0, y0), w, h, channels, mode, found, regions = plan.window, plan.width, plan.height, plan.channels, plan.mode, plan.levels, plan.regions
    kept = {(i, j): {c: np.zeros((-(-lh // sy), -(-lw // sx)), KINDS[k][1]) for c, k, sx, sy in channels} for i, j, lw, lh in found}
    table = struct.unpack(f"<{len(regions)}Q", data[at : at + 8 * len(regions)]) if at + 8 * len(regions) <= len(data) else ()
    if len(table) != len(regions):
        raise FormatError("exr", "TruncatedHeader", "offset table", at)
    steps = {c: (sx, sy) for c, _, sx, sy in channels}
    for region, place in zip(regions, table, strict=True):
        planes = kept[region[0]]
        for c, y, x, sx, values in chunk_rows(data, place, plan, number, bool(version & 0x1000), region):
            planes[c][y // steps[c][1], x // sx : x // sx + len(values)] = values
    kinds = {KINDS[k][0] for _, k, _, _ in channels}
    wide = np.float16 if kinds == {"float16"} else np.uint32 if kinds == {"uint32"} else np.float32
    whole = lambda planes, lw, lh: np.stack([np.repeat(np.repeat(planes[c], sy, 0), sx, 1)[:lh, :lw].astype(wide) for c, k, sx, sy in channels], 2)
    others = {(0, 0, 0, i if mode & 15 == 1 else (i, j)): whole(kept[i, j], lw, lh) for i, j, lw, lh in found[1:]}
    other = [("exr", name, exr_value(*held)) for name, held in attributes.items() if name not in RESERVED]
    return Image("exr", [c[0] for c in channels], np.dtype(wide).name, whole(kept[0, 0], w, h), metadata=other, window=(x0, y0), others=others), at + 8 * len(regions)


def encode(image: Image, compression: str = "zip", tile: tuple[int, int] | None = None, levels: int = 0) -> bytes:
    """levels: the mode of levels_of; lower ones stand in the image's `others`, as decode gives them."""
    return encode_parts([("", image)], compression, tile, levels)


def encode_parts(parts: list[tuple[str, Image]], compression: str = "zip", tile: tuple[int, int] | None = None, levels: int = 0) -> bytes:
    """Named parts, each in scan lines or, with `tile`, in tiles; more than one make a multi-part file."""
    code, (_, lines) = next((k, v) for k, v in COMPRESSIONS.items() if v[0] == compression)
    multi, heads, bodies, long_names = len(parts) > 1, b"", [], False
    for number, (name, image) in enumerate(parts):
        kind = {"uint32": 0, "float16": 1, "float32": 2}.get(image.sample)
        if kind is None:
            raise FormatError("exr", "Unsupported.Exr.Samples", image.sample)
        h, w, _ = image.samples.shape
        x0, y0 = image.window
        order = sorted(range(len(image.channels)), key=lambda i: image.channels[i])
        if levels and not tile:
            raise FormatError("exr", "BadOption", "levels need tiles")
        chunks = []
        for i, j, lw, lh in levels_of(w, h, levels):
            held = image.samples if not i and not j else image.others.get((0, 0, 0, i if levels & 15 == 1 else (i, j)))
            if held is None or held.shape[:2] != (lh, lw):
                raise FormatError("exr", "MissingLevel", f"{i}, {j}: {lw} x {lh}")
            planes = held[:, :, order].astype(KINDS[kind][1])
            step, across = (tile[1], tile[0]) if tile else (lines, w)
            for y in range(0, lh, step):
                for x in range(0, lw, across):
                    part = planes[y : y + step, x : x + across]
                    raw = np.ascontiguousarray(part.swapaxes(1, 2)).tobytes()
                    if compression == "piz":
                        made = make_piz(raw, [(image.channels[c], kind, yy, 0, part.shape[1]) for yy in range(part.shape[0]) for c in order])
                        packed = made if len(made) < len(raw) else raw
                    else:
                        packed = compress(compression, raw)
                    place = struct.pack("<4i", x // across, y // step, i, j) if tile else struct.pack("<i", y0 + y)
                    chunks.append((struct.pack("<i", number) if multi else b"") + place + struct.pack("<I", len(packed)) + packed)
        listed = b"".join(image.channels[i].encode() + b"\0" + struct.pack("<IB3xII", kind, 0, 1, 1) for i in order) + b"\0"
        box = struct.pack("<4i", x0, y0, x0 + w - 1, y0 + h - 1)
        attributes = [
            ("channels", "chlist", listed), ("compression", "compression", bytes([code])), ("dataWindow", "box2i", box), ("displayWindow", "box2i", box),
            ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", bytes(8)), ("screenWindowWidth", "float", struct.pack("<f", 1)),
        ]
        if tile:
            attributes.append(("tiles", "tiledesc", struct.pack("<IIB", *tile, levels)))
        if multi:
            attributes += [("name", "string", name.encode()), ("type", "string", b"tiledimage" if tile else b"scanlineimage"), ("chunkCount", "int", struct.pack("<i", len(chunks)))]
        attributes += [(key, *exr_attribute(value)) for space, key, value in image.metadata if space == "exr" and key not in RESERVED]
        long_names |= any(len(n.encode()) > 31 for n, _, _ in attributes)
        heads += b"".join(n.encode() + b"\0" + t.encode() + b"\0" + struct.pack("<I", len(v)) + v for n, t, v in attributes) + b"\0"
        bodies.append(chunks)
    out = MAGIC + struct.pack("<I", 2 | 0x1000 * multi | 0x200 * (tile is not None and not multi) | 0x400 * long_names) + heads + (b"\0" if multi else b"")
    at, tables = len(out) + 8 * sum(map(len, bodies)), []
    for chunks in bodies:
        for c in chunks:
            tables.append(at)
            at += len(c)
    return out + struct.pack(f"<{len(tables)}Q", *tables) + b"".join(c for chunks in bodies for c in chunks)
