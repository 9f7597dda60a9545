"""One large JPEG file decoded by several tasks, at its restart markers.

A restart marker begins a segment whose bits and DC predictions depend on nothing before it. One task finds the markers
of a file, which takes no decoding, and makes of each segment a small file of its own: the same tables, and a frame as
large as the segment's units, side by side. These are dealt out, decoded by the ordinary decoder, and their units put
where they belong. Chroma is replicated, as jpeg.decode does it without interpolation; so no unit needs its neighbours.

Files without markers, progressive ones, and those whose segments fit no frame (over MOST units that are no whole rows)
are one segment each. A file that can't be read is an error row without samples; a damaged segment is one for itself."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.sources import jpeg
from imagelake.sources.base import BROKEN, FormatError, Limits, described

#: Units that one row of a segment's frame may have: 16 pixels each, and a frame has 65,535 at most.
MOST = 4000


def _segment(marker: int, payload: bytes) -> bytes:
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(payload) + 2) + payload


def segments(data: bytes, limits: Limits = Limits()) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """(first unit, units in a row of the image, unit's width and height, image's width and height, file) of each segment."""
    parts_of, head, frame, scans = [], [], None, 0
    restart = 0
    for marker, p, parts in jpeg._segments(data):
        if marker == 0xDD:
            (restart,) = struct.unpack(">H", p)
        elif marker == 0xDA:
            scans, parts_of = scans + 1, parts
            head.append((marker, p))
        else:
            if marker in (0xC0, 0xC1, 0xC2):
                frame = (marker, p)
            head.append((marker, p))
    if frame is None or len(frame[1]) < 6 or not scans:
        raise FormatError("jpeg", "MissingFrame")
    depth, h, w, n = struct.unpack(">BHHB", frame[1][:6])
    if not w or not h or n not in (1, 3) or len(frame[1]) < 6 + 3 * n:
        raise FormatError("jpeg", "Unsupported.Jpeg.Frame", f"{n} components")
    limits.check(w, h, n)
    factors = [(frame[1][7 + 3 * i] >> 4, frame[1][7 + 3 * i] & 15) for i in range(n)]
    uw, uh = (8, 8) if n == 1 else (8 * max(f[0] for f in factors), 8 * max(f[1] for f in factors))
    if not uw or not uh:
        raise FormatError("jpeg", "BadSampling")
    across, down = -(-w // uw), -(-h // uh)
    whole = not restart or scans > 1 or frame[0] == 0xC2 or restart >= across * down or (restart > MOST and restart % across)
    if whole:
        yield 0, across, uw, uh, w, h, data
        return
    if len(parts_of) < -(-across * down // restart):
        raise FormatError("jpeg", "MissingRestart")
    for k, first in enumerate(range(0, across * down, restart)):
        units = min(restart, across * down - first)
        wide = units if units <= MOST else across
        made = struct.pack(">BHHB", depth, units // wide * uh, wide * uw, n) + frame[1][6:]
        tables = b"".join(_segment(m, made if m == frame[0] else p) for m, p in head)
        yield first, across, uw, uh, w, h, b"\xff\xd8" + tables + parts_of[k].replace(b"\xff", b"\xff\0") + b"\xff\xd9"


_INDEX = pa.schema([("segment", pa.int32()), ("first", pa.int64()), ("across", pa.int32()), ("unit_width", pa.int32()), ("unit_height", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
_INDEX_DDL = "segment int, first long, across int, unit_width int, unit_height int, width int, height int, content binary, error string"


def restart_index(files: DataFrame, carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """carry... and a row per segment of files (carry..., content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                try:
                    rows = [(k, *s, None) for k, s in enumerate(segments(b.column("_content")[i].as_py() or b""))]
                except BROKEN as e:
                    rows = [(0, None, None, None, None, None, None, None, str(described(e)))]
                at = pa.array([i] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in carry), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_INDEX))], [*carry, *_INDEX.names])

    source = files.select(*carry, F.col("content").alias("_content"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}, {_INDEX_DDL}")


def decode_restarts(files: DataFrame, carry: tuple[str, ...] = ("path",), tasks: int | None = None) -> DataFrame:
    """carry..., y, x, channel, value and error of files (carry..., content): the pixels of each file, its segments decoded
    apart in `tasks` tasks (as many as there are shuffle partitions, if none are named)."""
    n = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pixels(row: dict) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """y, x, channel names and samples (pixels, channels) of one segment, within the image."""
        image = jpeg.decode(row["content"], interpolate=False)
        v = image.samples
        if v.shape[:2] == (row["height"], row["width"]) and not row["first"] and row["whole"]:
            y, x = (a.ravel() for a in np.indices(v.shape[:2], np.int32))
        else:
            uw, uh = row["unit_width"], row["unit_height"]
            own = v.shape[1] // uw
            sy, sx = (a.ravel() for a in np.indices(v.shape[:2]))
            unit = row["first"] + sy // uh * own + sx // uw
            y, x = unit // row["across"] * uh + sy % uh, unit % row["across"] * uw + sx % uw
        inside = (y < row["height"]) & (x < row["width"])
        return y[inside].astype(np.int32), x[inside].astype(np.int32), image.channels, v.reshape(-1, v.shape[2])[inside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row in enumerate(b.select([*_INDEX.names, "whole"]).to_pylist()):
                error = row["error"]
                if error is None:
                    try:
                        y, x, channels, v = pixels(row)
                    except BROKEN as e:
                        error = str(described(e))
                if error is not None:
                    y = x = np.zeros(1, np.int32)
                    channels, v = [None], np.full((1, 1), np.nan)
                k = len(channels)
                at = pa.array(np.full(len(y) * k, i))
                made = [
                    pa.array(np.repeat(y, k)), pa.array(np.repeat(x, k)), pa.array(channels * len(y), pa.string()),
                    pa.array(v.astype(np.float64).ravel(), from_pandas=True), pa.array([error] * (len(y) * k), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in carry), *made], [*carry, "y", "x", "channel", "value", "error"])

    index = restart_index(files, carry).withColumn("whole", F.count(F.lit(1)).over(_window(carry)) == 1)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields[: len(carry)])
    dealt = index.repartition(n, *carry, "segment")
    return dealt.mapInArrow(run, f"{ddl}, y int, x int, channel string, value double, error string")


def _window(carry: tuple[str, ...]):
    from pyspark.sql import Window

    return Window.partitionBy(*carry)
