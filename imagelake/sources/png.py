"""PNG: chunk scan, decoding of all colour types, depths and interlacing, and encoding."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from imagelake.sources.base import FormatError, Image, Limits

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Channels by colour type, and the depths each allows.
CHANNELS = {0: "Y", 2: "RGB", 3: "I", 4: "YA", 6: "RGBA"}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def chunks(data: bytes):
    """(ordinal, type, payload, crc) of each chunk; checks lengths and checksums."""
    if data[:8] != SIGNATURE:
        raise FormatError("png", "BadSignature", "not a PNG file", 0)
    at, n = 8, 0
    while at < len(data):
        if at + 12 > len(data):
            raise FormatError("png", "TruncatedChunk", "chunk header beyond the end", at)
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + length > len(data):
            raise FormatError("png", "TruncatedChunk", f"{kind!r} beyond the end", at)
        payload = data[at + 8 : at + 8 + length]
        (crc,) = struct.unpack(">I", data[at + 8 + length : at + 12 + length])
        if zlib.crc32(kind + payload) != crc:
            raise FormatError("png", "BadCrc", f"{kind!r}", at)
        yield n, kind.decode("latin-1"), payload, crc
        at, n = at + 12 + length, n + 1
        if kind == b"IEND":
            return
    raise FormatError("png", "MissingEnd", "no IEND", at)


@dataclass
class Document:
    width: int = 0
    height: int = 0
    depth: int = 0
    color: int = 0
    interlaced: bool = False
    palette: bytes | None = None
    data: bytearray = field(default_factory=bytearray)
    metadata: list = field(default_factory=list)


def document(data: bytes, limits: Limits) -> Document:
    d, seen, ended = Document(), set(), False
    last = ""
    for n, kind, payload, _ in chunks(data):
        if (n == 0) != (kind == "IHDR"):
            raise FormatError("png", "BadOrder", f"{kind} at {n}")
        if kind in seen and kind not in ("IDAT", "tEXt", "zTXt", "iTXt") and kind[0].isupper() | (kind in ("gAMA", "sRGB", "cHRM", "iCCP", "tRNS")):
            raise FormatError("png", f"Duplicate{kind}", "appears twice")
        if kind == "IHDR":
            if len(payload) != 13:
                raise FormatError("png", "BadHeader", "length")
            d.width, d.height, d.depth, d.color, packing, filters, lace = struct.unpack(">IIBBBBB", payload)
            if not d.width or not d.height or d.depth not in DEPTHS.get(d.color, ()) or packing or filters or lace > 1:
                raise FormatError("png", "BadHeader", "values")
            limits.check(d.width, d.height, len(CHANNELS[d.color]) * max(8, d.depth) // 8)
            d.interlaced = bool(lace)
        elif kind == "PLTE":
            if "IDAT" in seen or len(payload) % 3 or not 3 <= len(payload) <= 768 or d.color in (0, 4):
                raise FormatError("png", "BadPalette", "place or length")
            d.palette = payload
        elif kind == "IDAT":
            if "IDAT" in seen and last != "IDAT":
                raise FormatError("png", "BadOrder", "image data is not consecutive")
            d.data += payload
        elif kind == "IEND":
            ended = True
        elif kind == "gAMA":
            d.metadata.append(("png", "gamma", struct.unpack(">I", payload)[0] / 100000))
        elif kind == "cHRM":
            d.metadata.append(("png", "chromaticities", [v / 100000 for v in struct.unpack(">8I", payload)]))
        elif kind == "sRGB":
            d.metadata.append(("png", "sRGB", payload[0]))
        elif kind == "iCCP":
            name, _, rest = payload.partition(b"\0")
            d.metadata.append(("png", "icc:" + name.decode("latin-1"), zlib.decompress(rest[1:])))
        elif kind == "tEXt":
            key, _, text = payload.partition(b"\0")
            d.metadata.append(("png.text", key.decode("latin-1"), text.decode("latin-1")))
        elif kind == "zTXt":
            key, _, rest = payload.partition(b"\0")
            d.metadata.append(("png.text", key.decode("latin-1"), zlib.decompress(rest[1:]).decode("latin-1")))
        elif kind == "iTXt":
            key, _, rest = payload.partition(b"\0")
            packed, rest = rest[0], rest[2:].split(b"\0", 2)[2]
            d.metadata.append(("png.text", key.decode("latin-1"), (zlib.decompress(rest) if packed else rest).decode("utf-8")))
        elif kind == "tRNS":
            d.metadata.append(("png", "tRNS", payload))
        elif kind[0].isupper():
            raise FormatError("png", "Unsupported.Png.Chunk", f"unknown critical chunk {kind}")
        seen.add(kind)
        last = kind
    if not ended or "IDAT" not in seen or (d.color == 3 and d.palette is None):
        raise FormatError("png", "MissingChunk", "image data, palette or end")
    return d


def unfilter(raw: np.ndarray, height: int, stride: int, bpp: int) -> np.ndarray:
    """Rows of a pass: (height, stride) bytes. Sub and up are prefix sums; average and Paeth follow a recurrence."""
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            padded = np.zeros(-(-stride // bpp) * bpp, np.uint8)
            padded[:stride] = line
            out[y] = np.cumsum(padded.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            out[y] = line + above
        elif kind == 3:
            here, up = bytearray(line.tobytes()), above.tobytes()
            for i in range(stride):
                here[i] = here[i] + ((here[i - bpp] if i >= bpp else 0) + up[i]) // 2 & 255
            out[y] = np.frombuffer(here, np.uint8)
        elif kind == 4:
            here, up = bytearray(line.tobytes()), above.tobytes()
            for i in range(stride):
                a, b, c = (here[i - bpp], up[i], up[i - bpp]) if i >= bpp else (0, up[i], 0)
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                here[i] = here[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c) & 255
            out[y] = np.frombuffer(here, np.uint8)
        else:
            raise FormatError("png", "BadFilter", f"type {kind}")
        above = out[y]
    return out


def _unpack(rows: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    if depth == 8:
        return rows.reshape(len(rows), width, channels).astype(np.uint16)
    if depth == 16:
        return np.ascontiguousarray(rows).view(">u2").astype(np.uint16).reshape(len(rows), width, channels)
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint16)[:, :, None]


def decode(data: bytes, limits: Limits = Limits()) -> Image:
    d = document(data, limits)
    channels = len(CHANNELS[d.color])
    bits = channels * d.depth
    passes = ADAM7 if d.interlaced else ((0, 0, 1, 1),)
    sizes = [(max(0, -(-(d.width - x0) // dx)), max(0, -(-(d.height - y0) // dy))) for x0, y0, dx, dy in passes]
    expected = sum(h * (1 + -(-w * bits // 8)) for w, h in sizes if w and h)
    engine = zlib.decompressobj()
    try:
        raw = engine.decompress(bytes(d.data), expected + 1)
    except zlib.error as e:
        raise FormatError("png", "MalformedData", str(e)) from e
    if len(raw) != expected:
        raise FormatError("png", "BadImageData", f"{len(raw)} bytes instead of {expected}")
    out, at = np.zeros((d.height, d.width, channels), np.uint16), 0
    for (x0, y0, dx, dy), (w, h) in zip(passes, sizes, strict=True):
        if not w or not h:
            continue
        stride = -(-w * bits // 8)
        part = np.frombuffer(raw, np.uint8, h * (stride + 1), at)
        at += h * (stride + 1)
        out[y0::dy, x0::dx] = _unpack(unfilter(part, h, stride, max(1, bits // 8)), w, channels, d.depth)
    image = Image("png", list(CHANNELS[d.color]), f"unorm{d.depth}", out, metadata=d.metadata)
    if d.color == 3:
        image.palette = np.frombuffer(d.palette, np.uint8).reshape(-1, 3)
        if int(out.max()) >= len(image.palette):
            raise FormatError("png", "BadPaletteIndex", "beyond the palette")
    return image


def _residuals(rows: np.ndarray, bpp: int) -> list[np.ndarray]:
    r = rows.astype(np.int16)
    left, up = np.zeros_like(r), np.zeros_like(r)
    left[:, bpp:], up[1:] = r[:, :-bpp], r[:-1]
    corner = np.zeros_like(r)
    corner[1:, bpp:] = r[:-1, :-bpp]
    pa, pb, pc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
    return [(r - p).astype(np.uint8) for p in (0 * r, left, up, (left + up) // 2, paeth)]


#: Levels of zlib by effort.
LEVELS = {"none": 0, "fast": 1, "optimal": 6, "smallest": 9}


def sampled_choice(rows: np.ndarray, bpp: int) -> tuple[int, str]:
    """A filter for all rows and an effort, from a trial on up to 8 rows of up to 512 bytes: the filter whose sample
    packs smallest; Paeth instead if all packs well and Paeth's sample is at most twice as large. Samples below a
    quarter of their size call for the most effort, those above three quarters for the least."""
    h, stride = rows.shape
    n, wide = min(h, 8), min(stride, 512)
    made = _residuals(rows, bpp)
    sizes = []
    for kind in range(5):
        packer = zlib.compressobj(1)
        out = 0
        for i in range(n):
            out += len(packer.compress(bytes([kind]) + made[kind][i * h // n, :wide].tobytes()))
        sizes.append(out + len(packer.flush()))
    best, whole = min(range(5), key=sizes.__getitem__), (wide + 1) * n
    small = sizes[best] * 4 < whole
    effort = "smallest" if small else "fast" if sizes[best] * 4 > whole * 3 else "optimal"
    return (4 if small and sizes[4] <= 2 * sizes[best] else best), effort


def high_entropy(rows: np.ndarray, bpp: int, least: float = 5.0) -> bool:
    """Whether no filter would help: over a grid of up to 16 rows and 128 columns, the mean over rows of the least entropy
    of the five filters' bytes is `least` bits or more. Images below 65,536 pixels are never judged so."""
    h, w = rows.shape[0], rows.shape[1] // bpp
    if h * w < 65_536:
        return False
    made = [m.reshape(h, w, bpp)[:: max(1, -(-h // 16)), :: max(1, -(-w // 128))] for m in _residuals(rows, bpp)]
    entropies = []
    for y in range(made[0].shape[0]):
        shares = [np.bincount(m[y].ravel(), minlength=256) / m[y].size for m in made]
        entropies.append(min(float(-(p[p > 0] * np.log2(p[p > 0])).sum()) for p in shares))
    return sum(entropies) / len(entropies) >= least


def _described(metadata: list) -> list[tuple[bytes, bytes]]:
    """Chunks of an image's metadata. Texts beyond Latin-1 are international ones."""
    out = []
    for space, key, value in metadata:
        if space == "png.text":
            head = key.encode("latin-1") + b"\0"
            try:
                out.append((b"tEXt", head + value.encode("latin-1")))
            except UnicodeEncodeError:
                out.append((b"iTXt", head + bytes(4) + value.encode()))
        elif space == "png" and key == "gamma":
            out.append((b"gAMA", struct.pack(">I", round(value * 100000))))
        elif space == "png" and key == "chromaticities":
            out.append((b"cHRM", struct.pack(">8I", *(round(v * 100000) for v in value))))
        elif space == "png" and key == "sRGB":
            out.append((b"sRGB", bytes([value])))
        elif space == "png" and key.startswith("icc:"):
            out.append((b"iCCP", key[4:].encode("latin-1") + b"\0\0" + zlib.compress(value)))
    return out


def encode(image: Image, level: int | None = None, row_filter: int | None = None, effort: str = "smallest") -> bytes:
    """8 or 16 bits, one to four channels or an index with a palette. Without a level or filter the effort decides:
    `smallest` tries filters on a sample, `fast` stores what no filter makes smaller; else a filter per row by least
    absolute sum."""
    names = "".join(image.channels)
    color = {v: k for k, v in CHANNELS.items()}.get(names)
    depth = int(image.sample.removeprefix("unorm")) if image.sample.startswith("unorm") else 0
    if color is None or depth not in DEPTHS[color]:
        raise FormatError("png", "Unsupported.Png.Samples", f"{names} {image.sample}")
    h, w, n = image.samples.shape
    if depth == 16:
        rows = np.ascontiguousarray(image.samples, ">u2").view(np.uint8).reshape(h, -1)
    elif depth == 8:
        rows = image.samples.astype(np.uint8).reshape(h, -1)
    else:
        bits = (image.samples[:, :, 0][:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
        rows = np.packbits(bits.astype(np.uint8).reshape(h, -1), axis=1)
    bpp = max(1, n * depth // 8)
    plain = level is None and color != 3 and depth >= 8
    if plain and effort == "smallest" and row_filter is None:
        row_filter, effort = sampled_choice(rows, bpp)
        level = 3 if effort == "fast" else LEVELS[effort]
    elif plain and effort == "fast" and high_entropy(rows, bpp):
        level = 0
    if level is None:
        level = LEVELS[effort]
    made = _residuals(rows, bpp)
    if row_filter is None and not level:
        kinds = np.zeros(h, int)
    elif row_filter is None:
        cost = np.stack([np.minimum(m.astype(np.int64), 256 - m.astype(np.int64)).sum(1) for m in made])
        kinds = np.zeros(h, int) if color == 3 or depth < 8 else cost.argmin(0)
    else:
        kinds = np.full(h, row_filter)
    lines = np.stack(made)[kinds, np.arange(h)]
    raw = np.concatenate((kinds.astype(np.uint8)[:, None], lines), axis=1).tobytes()

    def chunk(kind: bytes, payload: bytes) -> bytes:
        return struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))

    out = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0))
    out += b"".join(chunk(*c) for c in _described(image.metadata))
    if color == 3:
        out += chunk(b"PLTE", image.palette.astype(np.uint8).tobytes())
    return out + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")
