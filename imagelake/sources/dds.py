"""DDS and KTX2: texture containers whose subresources lie at computable offsets."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from imagelake.sources import texture
from imagelake.sources.base import FormatError, Image, Limits

# Name -> (DXGI code, Vulkan code, channels, sample, block width, bytes per element, block kind).
FORMATS = {
    "r8": (61, 9, "R", "unorm8", 1, 1, None), "rg8": (49, 16, "RG", "unorm8", 1, 2, None), "rgba8": (28, 37, "RGBA", "unorm8", 1, 4, None),
    "r16": (56, 70, "R", "unorm16", 1, 2, None), "rg16": (35, 77, "RG", "unorm16", 1, 4, None), "rgba16": (11, 91, "RGBA", "unorm16", 1, 8, None),
    "r16f": (54, 76, "R", "float16", 1, 2, None), "rg16f": (34, 83, "RG", "float16", 1, 4, None), "rgba16f": (10, 97, "RGBA", "float16", 1, 8, None),
    "r32f": (41, 100, "R", "float32", 1, 4, None), "rg32f": (16, 103, "RG", "float32", 1, 8, None), "rgba32f": (2, 109, "RGBA", "float32", 1, 16, None),
    "r10g10b10a2": (24, 64, "RGBA", "packed", 1, 4, "r10g10b10a2"), "r11g11b10f": (26, 122, "RGB", "packed", 1, 4, "r11g11b10f"),
    "rgb9e5": (67, 123, "RGB", "packed", 1, 4, "rgb9e5"), "b5g6r5": (85, None, "RGB", "packed", 1, 2, "b5g6r5"), "b5g5r5a1": (86, None, "RGBA", "packed", 1, 2, "b5g5r5a1"),
    "bc1": (71, 133, "RGBA", "unorm8", 4, 8, "bc1"), "bc2": (74, 135, "RGBA", "unorm8", 4, 16, "bc2"), "bc3": (77, 137, "RGBA", "unorm8", 4, 16, "bc3"),
    "bc4": (80, 139, "R", "unorm8", 4, 8, "bc4"), "bc5": (83, 141, "RG", "unorm8", 4, 16, "bc5"),
    "bc6h": (95, 143, "RGB", "float16", 4, 16, "bc6h"), "bc6h_signed": (96, 144, "RGB", "float16", 4, 16, "bc6h_signed"),
    "bc7": (98, 145, "RGBA", "unorm8", 4, 16, "bc7"),
}
_KIND = {"unorm8": np.uint8, "unorm16": "<u2", "float16": "<f2", "float32": "<f4"}
_FOURCC = {b"DXT1": "bc1", b"DXT3": "bc2", b"DXT5": "bc3", b"ATI1": "bc4", b"BC4U": "bc4", b"ATI2": "bc5", b"BC5U": "bc5"}
KTX2 = bytes((0xAB, 0x4B, 0x54, 0x58, 0x20, 0x32, 0x30, 0xBB, 0x0D, 0x0A, 0x1A, 0x0A))


@dataclass
class Layout:
    """What a header says, and where each subresource (element, face, level) lies: one after the other from `start` on, or
    by levels, from their (offset, stored bytes, whole bytes, whether packed). A damaged header can name millions of them,
    so places are told one at a time."""

    name: str
    width: int
    height: int
    depth: int = 1
    elements: int = 1
    faces: int = 1
    levels: int = 1
    metadata: list = field(default_factory=list)
    start: int = 0
    stored: list[tuple[int, int, int, bool]] | None = None

    def size(self, level: int) -> tuple[int, int, int]:
        return tuple(max(1, v >> level) for v in (self.width, self.height, self.depth))

    def bytes_of(self, level: int) -> int:
        w, h, d = self.size(level)
        _, _, _, _, block, size, _ = FORMATS[self.name]
        return math.ceil(w / block) * math.ceil(h / block) * d * size

    def places(self) -> Iterator[tuple[tuple, tuple[int, int, int | None]]]:
        """((element, face, level), (offset, bytes, None)); in a packed level, with the place within it as fourth key and its
        whole bytes as third value."""
        sizes, at = [self.bytes_of(lv) for lv in range(self.levels)], self.start
        if self.stored is None:
            for e in range(self.elements):
                for f in range(self.faces):
                    for lv in range(self.levels):
                        yield (e, f, lv), (at, sizes[lv], None)
                        at += sizes[lv]
            return
        for lv, (offset, stored, whole, packed) in enumerate(self.stored):
            for e in range(self.elements):
                for f in range(self.faces):
                    inner = (e * self.faces + f) * sizes[lv]
                    yield ((e, f, lv, inner), (offset, stored, whole)) if packed else ((e, f, lv), (offset + inner, sizes[lv], None))


def elements_to_samples(name: str, raw: bytes, w: int, h: int, d: int = 1) -> np.ndarray:
    _, _, channels, sample, block, _, kind = FORMATS[name]
    if block == 4:
        slices = [texture.decode_image(kind, raw[k * len(raw) // d : (k + 1) * len(raw) // d], w, h) for k in range(d)]
        return np.concatenate(slices) if d > 1 else slices[0]
    if sample == "packed":
        return texture.unpack(kind, raw).reshape(h * d, w, len(channels))
    return np.frombuffer(raw, _KIND[sample]).reshape(h * d, w, len(channels))


def samples_to_elements(name: str, samples: np.ndarray) -> bytes:
    _, _, channels, sample, block, _, kind = FORMATS[name]
    if samples.shape[2] != len(channels):
        raise FormatError("texture", "Unsupported.Channels", f"{samples.shape[2]} for {name}")
    if block == 4:
        return texture.encode_image(kind, samples)
    return texture.pack(kind, samples) if sample == "packed" else samples.astype(_KIND[sample]).tobytes()


def _image(fmt: str, data: bytes, layout: Layout, limits: Limits) -> Image:
    limits.check(layout.width, layout.height, 16, layout.depth * layout.elements * layout.faces)
    _, _, channels, sample, _, _, kind = FORMATS[layout.name]
    found = {}
    for key, (at, stored, packed) in layout.places():
        raw, level = data[at : at + stored], key[2]
        if len(raw) != stored:
            raise FormatError(fmt, "TruncatedData", f"subresource {key}", at)
        if packed:
            whole = raw if not isinstance(packed, int) else zlib.decompressobj().decompress(raw, packed + 1)
            raw = whole[key[3] :][: layout.bytes_of(level)] if len(key) > 3 else whole
        if len(raw) != layout.bytes_of(level):
            raise FormatError(fmt, "BadLevelSize", f"subresource {key}", at)
        w, h, d = layout.size(level)
        found[key[:3]] = elements_to_samples(layout.name, raw, w, h, d)
    base = found.pop((0, 0, 0))
    return Image(fmt, list(channels), "float32" if sample == "packed" else sample, base, metadata=layout.metadata, encoding=layout.name if kind else None, others={(0, *k): v for k, v in found.items()})


# ---------------------------------------------------------------- DDS


def dds_layout(data: bytes) -> Layout:
    if data[:4] != b"DDS ":
        raise FormatError("dds", "BadSignature", "", 0)
    if len(data) < 128:
        raise FormatError("dds", "TruncatedHeader", "", len(data))
    size, flags, h, w, _, depth, levels = struct.unpack("<7I", data[4:32])
    pf_size, pf_flags, fourcc, bits, r, g, b, a = struct.unpack("<II4s5I", data[76:108])
    (caps2,) = struct.unpack("<I", data[112:116])
    if size != 124 or pf_size != 32 or not w or not h:
        raise FormatError("dds", "BadHeader", "sizes", 4)
    elements, faces, at, name = 1, 6 if caps2 & 0x200 else 1, 128, None
    if pf_flags & 4 and fourcc == b"DX10":
        code, dimension, misc, elements, _ = struct.unpack("<5I", data[128:148])
        at, faces = 148, 6 if misc & 4 else 1
        name = next((k for k, v in FORMATS.items() if v[0] == code), None)
        depth = depth if dimension == 4 else 1
        if not elements:
            raise FormatError("dds", "BadHeader", "array size", 140)
        if elements > Limits().array_elements:
            raise FormatError("dds", "LimitExceeded", f"{elements} array elements")
    elif pf_flags & 4:
        name = _FOURCC.get(fourcc)
    else:
        masks = (bits, r, g, b, a if pf_flags & 1 else 0)
        name = {(32, 0xFF, 0xFF00, 0xFF0000, 0xFF000000): "rgba8", (16, 0xF800, 0x7E0, 0x1F, 0): "b5g6r5", (16, 0x7C00, 0x3E0, 0x1F, 0x8000): "b5g5r5a1", (8, 0xFF, 0, 0, 0): "r8"}.get(masks)
    if name is None:
        raise FormatError("dds", "Unsupported.Dds.Format", fourcc.decode("latin-1"))
    layout = Layout(name, w, h, max(1, depth) if flags & 0x800000 or depth else 1, elements, faces, max(1, levels), start=at)
    if layout.levels > max(w, h, layout.depth).bit_length():
        raise FormatError("dds", "BadHeader", "levels")
    return layout


def decode_dds(data: bytes, limits: Limits = Limits()) -> Image:
    return _image("dds", data, dds_layout(data), limits)


def _items(image: Image, name: str) -> tuple[Layout, dict]:
    found = {(0, 0, 0): image.samples} | {k[1:]: v for k, v in image.others.items()}
    elements, faces, levels = (1 + max(k[i] for k in found) for i in range(3))
    h, w, _ = image.samples.shape
    if len(found) != elements * faces * levels or faces not in (1, 6):
        raise FormatError("texture", "IncompleteImage", f"{len(found)} subresources")
    return Layout(name, w, h, 1, elements, faces, levels), found


def name_for(image: Image, encoding: str | None) -> str:
    wanted = encoding or image.encoding
    if wanted:
        return wanted
    letters, sample = "".join(image.channels), image.sample
    for k, v in FORMATS.items():
        if v[2] == letters and v[3] == sample and v[6] is None:
            return k
    raise FormatError("texture", "Unsupported.Samples", f"{letters} {sample}")


def encode_dds(image: Image, encoding: str | None = None) -> bytes:
    name = name_for(image, encoding)
    layout, found = _items(image, name)
    h, w, _ = image.samples.shape
    block = FORMATS[name][4]
    pitch = math.ceil(w / block) * FORMATS[name][5]
    flags = 0x1007 | (0x80000 if block == 4 else 8) | (0x20000 if layout.levels > 1 else 0)
    caps = 0x1000 | (0x400008 if layout.levels > 1 or layout.faces == 6 else 0)
    out = b"DDS " + struct.pack("<7I", 124, flags, h, w, layout.bytes_of(0) if block == 4 else pitch, 0, layout.levels) + bytes(44)
    out += struct.pack("<II4s5I", 32, 4, b"DX10", 0, 0, 0, 0, 0) + struct.pack("<5I", caps, 0xFE00 if layout.faces == 6 else 0, 0, 0, 0)
    out += struct.pack("<5I", FORMATS[name][0], 3, 4 if layout.faces == 6 else 0, layout.elements, 0)
    keys = [(e, f, lv) for e in range(layout.elements) for f in range(layout.faces) for lv in range(layout.levels)]
    return out + b"".join(samples_to_elements(name, found[k]) for k in keys)


# ---------------------------------------------------------------- KTX2


def header_bytes(data: bytes) -> int:
    """How much of a file says where everything lies, from its first 80 bytes or more."""
    if data[:12] != KTX2 or len(data) < 80:
        return 148
    levels = max(1, struct.unpack("<I", data[40:44])[0])
    dfd_at, dfd_n, kv_at, kv_n = struct.unpack("<4I", data[48:64])
    return max(80 + 24 * min(levels, 64), dfd_at + dfd_n, kv_at + kv_n)


def ktx2_layout(data: bytes) -> Layout:
    if data[:12] != KTX2:
        raise FormatError("ktx2", "BadSignature", "", 0)
    if len(data) < 80:
        raise FormatError("ktx2", "TruncatedHeader", "", len(data))
    code, _, w, h, d, elements, faces, levels, scheme = struct.unpack("<9I", data[12:48])
    dfd_at, dfd_n, kv_at, kv_n = struct.unpack("<4I", data[48:64])
    name = next((k for k, v in FORMATS.items() if v[1] == code and code), None)
    if name is None:
        raise FormatError("ktx2", "Unsupported.Ktx2.Format", str(code))
    if scheme not in (0, 3):
        raise FormatError("ktx2", "Unsupported.Ktx2.Supercompression", str(scheme))
    if not w or faces not in (1, 6) or dfd_n < 44 or dfd_at + dfd_n > len(data) or kv_at + kv_n > len(data):
        raise FormatError("ktx2", "BadHeader", "extent, faces or ranges")
    if elements > Limits().array_elements or levels > Limits().levels:
        raise FormatError("ktx2", "LimitExceeded", f"{elements} array elements, {levels} levels")
    layout = Layout(name, w, max(1, h), max(1, d), max(1, elements), faces, max(1, levels), stored=[])
    check_dfd(data[dfd_at : dfd_at + dfd_n], name)
    at = kv_at
    while at + 4 <= kv_at + kv_n:
        (n,) = struct.unpack("<I", data[at : at + 4])
        key, _, value = data[at + 4 : at + 4 + n].partition(b"\0")
        layout.metadata.append(("ktx2", key.decode("utf-8"), value))
        at += 4 + n + -n % 4
    for lv in range(layout.levels):
        offset, stored, whole = struct.unpack("<3Q", data[80 + 24 * lv : 104 + 24 * lv])
        part = layout.bytes_of(lv)
        if whole != part * layout.elements * faces or (not scheme and stored != whole):
            raise FormatError("ktx2", "BadLevelSize", f"level {lv}", 80 + 24 * lv)
        layout.stored.append((offset, stored, int(whole), bool(scheme)))
    return layout


def decode_ktx2(data: bytes, limits: Limits = Limits()) -> Image:
    return _image("ktx2", data, ktx2_layout(data), limits)


def _samples_of(name: str) -> list[tuple[int, int, int, int, int]]:
    """(first bit, bits, channel, lower, upper) of the data format descriptor."""
    _, _, channels, sample, block, size, kind = FORMATS[name]
    ids = {"R": 0, "G": 1, "B": 2, "A": 15}
    if block == 4:
        if kind.startswith("bc6h"):
            return [(0, 128, 0xC0, 0xBF800000, 0x3F800000) if kind.endswith("signed") else (0, 128, 0x80, 0, 0x3F800000)]
        parts = {"bc2": ((0, 64, 15), (64, 64, 0)), "bc3": ((0, 64, 15), (64, 64, 0)), "bc5": ((0, 64, 0), (64, 64, 1))}.get(kind, ((0, size * 8, 0),))
        return [(a, n, c, 0, 0xFFFFFFFF) for a, n, c in parts]
    if sample == "packed":
        from imagelake.functions.packed import FIELDS

        fields = [(at, n, ids[c.upper()]) for c, at, n in FIELDS[kind] if c != "e"]
        out = [(at, n, c, 0, (1 << n) - 1) for at, n, c in fields]
        return out + [(27, 5, 0x20 | c, 15, 31) for _, _, c in fields] if kind == "rgb9e5" else out
    n = size * 8 // len(channels)
    flag = 0xC0 if sample.startswith("float") else 0
    lower, upper = (0xBF800000, 0x3F800000) if flag else (0, (1 << n) - 1)
    return [(i * n, n, ids[c] | flag, lower, upper) for i, c in enumerate(channels)]


def make_dfd(name: str) -> bytes:
    _, _, _, _, block, size, kind = FORMATS[name]
    model = {"bc1": 128, "bc2": 129, "bc3": 130, "bc4": 131, "bc5": 132, "bc6h": 133, "bc6h_signed": 133, "bc7": 134}.get(kind, 1)
    samples = _samples_of(name)
    n = 24 + 16 * len(samples)
    out = struct.pack("<IIHHBBBB4B8B", n + 4, 0, 2, n, model, 1, 1, 0, block - 1, block - 1, 0, 0, size, *[0] * 7)
    for at, bits, channel, lower, upper in samples:
        out += struct.pack("<HBBIII", at, bits - 1, channel, 0, lower, upper)
    return out


def check_dfd(dfd: bytes, name: str) -> None:
    """One basic block of version 2 whose samples cover the element's bits in order."""
    total, vendor, version, n = struct.unpack("<IIHH", dfd[:12])
    if total != len(dfd) or vendor or version != 2 or n != total - 4 or (n - 24) % 16:
        raise FormatError("ktx2", "BadDfd", "block")
    block, size = FORMATS[name][4], FORMATS[name][5]
    if dfd[16] + 1 != block or dfd[17] + 1 != block or dfd[20] != size:
        raise FormatError("ktx2", "BadDfd", "texel block")
    at = 0
    for k in range(28, len(dfd), 16):
        first, bits, channel = struct.unpack("<HBB", dfd[k : k + 4])
        if not channel & 0x20:
            if first != at:
                raise FormatError("ktx2", "BadDfd", "samples don't tile the element")
            at = first + bits + 1
    if at != size * 8 and name != "rgb9e5":
        raise FormatError("ktx2", "BadDfd", "samples don't tile the element")


def encode_ktx2(image: Image, encoding: str | None = None, compress: bool = False) -> bytes:
    name = name_for(image, encoding)
    layout, found = _items(image, name)
    code = FORMATS[name][1]
    if code is None:
        raise FormatError("ktx2", "Unsupported.Ktx2.Format", name)
    h, w, _ = image.samples.shape
    dfd, kv = make_dfd(name), b""
    for ns, key, value in image.metadata:
        if ns == "ktx2":
            pair = key.encode() + b"\0" + value
            kv += struct.pack("<I", len(pair)) + pair + bytes(-len(pair) % 4)
    dfd_at = 80 + 24 * layout.levels
    kv_at = dfd_at + len(dfd)
    body_at, body, index = kv_at + len(kv), b"", {}
    align = 1 if compress else math.lcm(FORMATS[name][5], 4)
    for lv in reversed(range(layout.levels)):  # the smallest first
        whole = b"".join(samples_to_elements(name, found[e, f, lv]) for e in range(layout.elements) for f in range(layout.faces))
        body += bytes(-(body_at + len(body)) % align)
        stored = zlib.compress(whole) if compress else whole
        index[lv] = (body_at + len(body), len(stored), len(whole))
        body += stored
    head = KTX2 + struct.pack("<9I", code, {"unorm8": 1, "unorm16": 2, "float16": 2, "float32": 4}.get(FORMATS[name][3], 4) if FORMATS[name][4] == 1 else 1, w, h, 0, layout.elements if layout.elements > 1 else 0, layout.faces, layout.levels, 3 if compress else 0)
    head += struct.pack("<4I2Q", dfd_at, len(dfd), kv_at if kv else 0, len(kv), 0, 0)
    return head + b"".join(struct.pack("<3Q", *index[lv]) for lv in range(layout.levels)) + dfd + kv + body
