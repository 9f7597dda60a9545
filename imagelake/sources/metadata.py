"""Metadata of images between formats: what each writer can say, under which name, and what is lost on the way.

An entry is (namespace, key, value); a value is text, a number, a list of numbers, or bytes. Between formats an entry is
first read as a term that formats share, or as a text with a name of its own, and then written as the target says it.
What has no place in the target is a loss of kind `metadata`, never a silence:

- renamed, retyped: the same under another name or in another type; no semantic loss
- rounded: a figure the target holds with fewer digits
- dropped: no counterpart, characters the target can't hold, a name that is taken, or a description of stored pixels"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.plans.planner import Loss

#: Shared terms and their names by format; where a format has no name, texts keep the term's PNG name, but in JPEG, which
#: has comments only.
TERMS = {
    "title": {"png": "Title"},
    "author": {"png": "Author"},
    "description": {"png": "Description"},
    "copyright": {"png": "Copyright", "exr": "owner"},
    "created": {"png": "Creation Time", "exr": "capDate"},
    "software": {"png": "Software", "ktx2": "KTXwriter", "hdr": "SOFTWARE"},
    "comment": {"png": "Comment", "exr": "comments", "jpeg": "comment"},
    "chromaticities": {"png": "chromaticities", "exr": "chromaticities", "hdr": "PRIMARIES"},
}
#: Where a writer puts texts.
SPACES = {"png": "png.text", "exr": "exr", "ktx2": "ktx2", "hdr": "hdr", "jpeg": "jpeg"}
#: Entries that describe the samples as they were stored.
OF_PIXELS = (("png", "tRNS"), ("ktx2", "KTXorientation"), ("ktx2", "KTXswizzle"))
#: Segments that a writer makes itself.
_MADE = (("jpeg", "app0"), ("jpeg", "app14"))
_FIGURES = ("chromaticities",)


def _known(fmt: str, key: str) -> str | None:
    """The term of a format's key."""
    for term, names in TERMS.items():
        if names.get(fmt, names["png"] if fmt != "jpeg" and term not in _FIGURES else None) == key:
            return term
    return None


def _numbers(value: object, size: int) -> list[float] | None:
    parts = value.split() if isinstance(value, str) else value
    try:
        out = [float(v) for v in parts]
    except (TypeError, ValueError):
        return None
    return out if len(out) == size and np.isfinite(out).all() else None


def neutral(space: str, key: str, value: object) -> tuple[str | None, str, object]:
    """(term, name, value) of an entry: text, or chromaticities as white, red, green, blue; None where it is neither."""
    fmt = space.partition(".")[0]
    term = _known(fmt, key)
    if term in _FIGURES:
        v = _numbers(value, 8)
        return term, key, v if v is None or fmt == "png" else v[6:] + v[:6]  # elsewhere white is the last
    if space == "png" or space == "exr.part" or (fmt == "jpeg" and term is None):
        return term, key, None
    if fmt == "ktx2" and isinstance(value, bytes):
        value = value.removesuffix(b"\0") if value.endswith(b"\0") else None
    if isinstance(value, bytes):
        try:
            return term, key, value.decode("utf-8")
        except UnicodeDecodeError:
            return term, key, value.decode("latin-1") if fmt == "jpeg" else None
    return term, key, value if isinstance(value, str | int | float) else None


def _writable(fmt: str, key: str, text: str) -> str | None:
    """Why a format can't hold a text, or None."""
    if fmt == "png" and not (0 < len(key) < 80 and key == " ".join(key.split(" ")).strip() and "  " not in key and all(" " <= c <= "~" or "\xa1" <= c <= "\xff" for c in key)):
        return "no keyword"
    if fmt == "jpeg":
        return "too long" if len(text.encode()) > 65533 else None
    if fmt == "exr" and not 0 < len(key.encode()) < 256:
        return "no attribute name"
    if fmt == "hdr":
        if not key or set(key) & set("=\n\r#") or set(text) & set("\n\r") or key != key.strip() or text != text.strip() or key == "FORMAT":
            return "no single line"
        return None if all(c <= "\xff" for c in key + text) else "characters"
    return "a zero character" if "\0" in key or "\0" in text else None


def _written(fmt: str, term: str | None, name: str, value: object) -> tuple[tuple[str, str, object] | None, str | None]:
    """(entry, None), (entry, rounding) or (None, reason)."""
    names = TERMS.get(term, {})
    if term in _FIGURES:
        if fmt not in names:
            return None, "no counterpart"
        if fmt == "png":
            steps = [round(v * 100000) for v in value]
            if min(steps) < 0 or max(steps) >= 1 << 31:
                return None, "out of range"
            kept = [s / 100000 for s in steps]
            return ("png", names[fmt], kept), None if np.array_equal(np.float32(kept), np.float32(value)) else "rounded"
        turned = value[2:] + value[:2]
        if fmt == "hdr":
            return (fmt, names[fmt], " ".join(f"{v:.7g}" for v in turned)), None
        return (fmt, names[fmt], [float(np.float32(v)) for v in turned]), None
    key = names.get(fmt) or (None if fmt == "jpeg" else names.get("png", name))
    if key is None:
        return None, "no counterpart"
    if term is None and _known(fmt, key):
        return None, "a name with another meaning"
    if fmt == "ktx2" and term is None and key[:3].lower() == "ktx":
        return None, "a reserved name"
    text = value if isinstance(value, str) else repr(value)
    reason = _writable(fmt, key, text)
    if reason:
        return None, reason
    stored = text.encode() + b"\0" if fmt == "ktx2" else text.encode() if fmt == "jpeg" else value if fmt == "exr" else text
    return (SPACES[fmt], key, stored), None if stored == value or isinstance(value, str) else "retyped"


def translated(entries: list[tuple[str, str, object]], fmt: str) -> tuple[list[tuple[str, str, object]], list[Loss]]:
    """The entries as a file of format `fmt` holds them, and the losses. Entries of that format stay as they are."""
    out, losses, taken = [], [], set()
    for space, key, value in entries:
        if (space, key) in _MADE:
            continue
        lost = lambda why, semantic=True, at=f"{space} {key}": losses.append(Loss("metadata", f"{at}: {why}", semantic))
        if (space, key) in OF_PIXELS:
            lost("dropped, it describes stored pixels")
            continue
        if fmt not in SPACES:
            lost("dropped, the format's writer has no metadata")
            continue
        if space.partition(".")[0] == fmt and space != "exr.part" and (fmt != "jpeg" or key == "comment"):
            entry, note = (space, key, value), None
        else:
            term, name, v = neutral(space, key, value)
            entry, note = _written(fmt, term, name, v) if v is not None else (None, "no counterpart")
            if entry and note:
                lost(note, note == "rounded")
            elif entry and entry[1] != key:
                lost(f"renamed to {entry[1]}", False)
        if entry is None:
            lost(f"dropped, {note}")
        elif entry[:2] in taken and not (fmt == "jpeg" or entry[0] == "png.text"):  # comments and texts may repeat
            lost(f"dropped, {entry[1]} is taken")
        else:
            taken.add(entry[:2])
            out.append(entry)
    return out, losses


# ---------------------------------------------------------------- EXR attributes


def exr_value(kind: str, raw: bytes) -> object:
    """An attribute's value where its type is one of texts and figures; else the type and its bytes."""
    if kind == "string":
        return raw.decode("utf-8", "replace")
    form = {"int": "<i", "float": "<f", "double": "<d", "chromaticities": "<8f"}.get(kind)
    if form is None or len(raw) != struct.calcsize(form):
        return kind, raw
    v = struct.unpack(form, raw)
    return list(v) if len(v) > 1 else v[0] if kind != "double" else (kind, raw)


def exr_attribute(value: object) -> tuple[str, bytes]:
    if isinstance(value, tuple):
        return value
    if isinstance(value, str):
        return "string", value.encode()
    if isinstance(value, list):
        return "chromaticities", struct.pack("<8f", *value)
    if isinstance(value, int) and -(1 << 31) <= value < 1 << 31:
        return "int", struct.pack("<i", value)
    return "float", struct.pack("<f", value)


# ---------------------------------------------------------------- rows


def shown(value: object) -> str:
    """A value as text: bytes in hex, without a zero that ends a text; figures apart by blanks."""
    if isinstance(value, tuple):
        value = value[-1]
    if isinstance(value, bytes):
        try:
            return value.removesuffix(b"\0").decode("utf-8") if value.endswith(b"\0") else value.hex()
        except UnicodeDecodeError:
            return value.hex()
    return " ".join(f"{v:.7g}" for v in value) if isinstance(value, list) else value if isinstance(value, str) else f"{value:.7g}" if isinstance(value, float) else str(value)


def file_metadata(files: DataFrame, carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """(carry..., namespace, key, value) of image files of all formats, in the order in which a file holds them (ordinal);
    null and damaged files have no rows."""
    from imagelake.sources.base import BROKEN, Limits
    from imagelake.sources.catalog import REGISTRY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, rows = [], []
            for i, data in enumerate(b.column("_content")):
                data = data.as_py() or b""
                try:
                    found = REGISTRY.resolve(data[:16]).decode(data, Limits()).metadata
                except BROKEN:
                    continue
                where += [i] * len(found)
                rows += [(n, space, key, shown(value)) for n, (space, key, value) in enumerate(found)]
            at, columns = pa.array(where, pa.int64()), list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in carry), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*carry, "ordinal", "namespace", "key", "value"])

    source = files.select(*carry, F.col("content").alias("_content"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}, ordinal int, namespace string, key string, value string")
