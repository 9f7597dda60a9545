"""Radiance HDR: header, run-length rows and shared-exponent pixels."""

from __future__ import annotations

import re

import numpy as np

from imagelake.sources.base import FormatError, Image, Limits


def header(data: bytes) -> tuple[int, int, str, int, list]:
    """width, height, orientation, start of the pixels, metadata."""
    if not data.startswith((b"#?RADIANCE", b"#?RGBE")):
        raise FormatError("hdr", "BadSignature", "", 0)
    at, found, metadata = data.find(b"\n") + 1, False, []
    while True:
        end = data.find(b"\n", at)
        if at == 0 or end < 0:
            raise FormatError("hdr", "TruncatedHeader", "", at)
        line, at = data[at:end].decode("latin-1").strip(), end + 1
        if not line:
            break
        if line.startswith("FORMAT="):
            if line != "FORMAT=32-bit_rle_rgbe":
                raise FormatError("hdr", "Unsupported.Hdr.Format", line)
            found = True
        elif "=" in line and not line.startswith("#"):
            key, _, value = line.partition("=")
            metadata.append(("hdr", key, value))
    if not found:
        raise FormatError("hdr", "MissingFormat", "")
    end = data.find(b"\n", at)
    m = re.fullmatch(r"([+-])Y (\d+) ([+-])X (\d+)", data[at:end].decode("latin-1").strip()) if end > 0 else None
    if not m or not int(m[2]) or not int(m[4]):
        raise FormatError("hdr", "BadResolution", data[at : at + 40].decode("latin-1"), at)
    name = {("-", "+"): "identity", ("-", "-"): "flip_x", ("+", "+"): "flip_y", ("+", "-"): "rotate180"}[m[1], m[3]]
    return int(m[4]), int(m[2]), name, end + 1, metadata


def decode_rgbe(rgbe: np.ndarray) -> np.ndarray:
    e = rgbe[..., 3].astype(np.int32)
    scale = np.where(e == 0, 0.0, np.ldexp(1.0, e - 136))
    return (rgbe[..., :3] * scale[..., None]).astype(np.float32)


def encode_rgbe(rgb: np.ndarray) -> np.ndarray:
    """Negatives count as 0, mantissas are truncated, a top that isn't finite or is below 1e-32 gives zeros."""
    v = np.maximum(np.nan_to_num(rgb.astype(np.float64), nan=0.0, posinf=np.inf), 0)
    top = v.max(-1)
    bad = ~np.isfinite(top) | (top < 1e-32)
    _, e = np.frexp(np.where(bad, 1.0, top))
    e = np.clip(e, -128, 127)
    out = np.empty((*v.shape[:-1], 4), np.uint8)
    out[..., :3] = np.minimum(np.floor(np.where(bad[..., None], 0, v) * np.ldexp(1.0, 8 - e)[..., None]), 255)
    out[..., 3] = e + 128
    out[bad] = 0
    return out


def decode(data: bytes, limits: Limits = Limits()) -> Image:
    w, h, orientation, at, metadata = header(data)
    limits.check(w, h, 12)
    rgbe = np.zeros((h, w, 4), np.uint8)
    if 8 <= w <= 32767 and data[at : at + 2] == b"\2\2":
        for y in range(h):
            if data[at : at + 4] != bytes((2, 2, w >> 8, w & 255)):
                raise FormatError("hdr", "BadScanline", f"row {y}", at)
            at += 4
            for c in range(4):
                x, line = 0, rgbe[y, :, c]
                while x < w:
                    if at + 1 >= len(data):
                        raise FormatError("hdr", "TruncatedData", f"row {y}", at)
                    code = data[at]
                    n = code - 128 if code > 128 else code
                    if not n or x + n > w:
                        raise FormatError("hdr", "BadRun", f"row {y}", at)
                    if code > 128:
                        line[x : x + n] = data[at + 1]
                        at += 2
                    else:
                        part = data[at + 1 : at + 1 + n]
                        if len(part) != n:
                            raise FormatError("hdr", "TruncatedData", f"row {y}", at)
                        line[x : x + n] = np.frombuffer(part, np.uint8)
                        at += 1 + n
                    x += n
    else:
        if len(data) - at < w * h * 4:
            raise FormatError("hdr", "TruncatedData", "flat pixels", at)
        rgbe = np.frombuffer(data, np.uint8, w * h * 4, at).reshape(h, w, 4)
    return Image("hdr", ["R", "G", "B"], "float32", decode_rgbe(rgbe), metadata=metadata, orientation=orientation, encoding="rgbe")


def _pack_row(values: bytes) -> bytes:
    """Runs of four and more, literals of up to 128."""
    out, i, n, start = bytearray(), 0, len(values), 0
    while i < n:
        j = i
        while j < n and j - i < 127 and values[j] == values[i]:
            j += 1
        if j - i >= 4:
            for k in range(start, i, 128):
                part = values[k : min(i, k + 128)]
                out.append(len(part))
                out += part
            out += bytes((128 + j - i, values[i]))
            start = j
        i = j
    for k in range(start, n, 128):
        part = values[k : k + 128]
        out.append(len(part))
        out += part
    return bytes(out)


def encode(image: Image) -> bytes:
    if image.channels[:3] != ["R", "G", "B"] or image.sample != "float32":
        raise FormatError("hdr", "Unsupported.Hdr.Channels", "".join(image.channels))
    h, w, _ = image.samples.shape
    rgbe = encode_rgbe(image.samples[..., :3])
    signs = {"identity": "-Y {h} +X {w}", "flip_x": "-Y {h} -X {w}", "flip_y": "+Y {h} +X {w}", "rotate180": "+Y {h} -X {w}"}
    lines = "".join(f"{key}={value}\n" for space, key, value in image.metadata if space == "hdr").encode("latin-1")
    out = bytearray(b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n" + lines + b"\n" + signs[image.orientation].format(h=h, w=w).encode() + b"\n")
    if not 8 <= w <= 32767:
        return bytes(out) + rgbe.tobytes()
    for y in range(h):
        out += bytes((2, 2, w >> 8, w & 255))
        for c in range(4):
            out += _pack_row(rgbe[y, :, c].tobytes())
    return bytes(out)
