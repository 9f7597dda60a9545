"""`exr`, a data source of OpenEXR samples whose partitions come from the files' tables of chunk offsets.

spark.read.format("exr").load(path) gives (path, part, level_x, level_y, y, x, channel, value), y and x counted from the
data window's corner; samples of a subsampled channel stand at the places they are stored for. The driver reads headers
and offset tables only. Neighbouring chunks become a partition of about `chunkbytes` bytes as they decode, whatever the
file's size, and filters on part, level_x, level_y, y and x leave out chunks (rows or tiles) before anything is read."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from imagelake.sources import exr
from imagelake.sources.base import FormatError, Limits
from imagelake.sources.files import listed, read_bytes

#: Bytes of a header that are read first; a longer one is read in doubling steps.
HEADER = 1 << 16
#: Samples of a batch.
SAMPLES = 1 << 16


def header_of(path: str) -> tuple[list[dict], int, int]:
    """exr.headers() from as much of a file as it takes."""
    size = HEADER
    while True:
        data = read_bytes(path, 0, size)
        try:
            return exr.headers(data)
        except FormatError as e:
            if e.code != "TruncatedHeader" or len(data) < size:
                raise
            size *= 2


class ChunkRun(InputPartition):
    """Neighbouring chunks of one part: (region, offset) each, and where the bytes after the last one begin, if known."""

    def __init__(self, path: str, number: int, multi: bool, plan: exr.Plan, chunks: list, end: int | None):
        self.path, self.number, self.multi, self.plan, self.chunks, self.end = path, number, multi, plan, chunks, end


class ExrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("chunkbytes", 8 << 20))
        self.bounds: dict[str, list[int | None]] = {c: [None, None] for c in ("part", "level_x", "level_y", "y", "x")}

    def pushFilters(self, filters):
        for f in filters:
            kind, name = type(f).__name__, f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.bounds and isinstance(getattr(f, "value", None), int):
                low, high = self.bounds[name]
                v = f.value
                if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                    least = v + (kind == "GreaterThan")
                    low = least if low is None else max(low, least)
                if kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                    most = v - (kind == "LessThan")
                    high = most if high is None else min(high, most)
                self.bounds[name] = [low, high]
            yield f  # Spark filters again; leaving chunks out is all that happens here

    def within(self, name: str, first: int, last: int) -> bool:
        low, high = self.bounds[name]
        return (low is None or last >= low) and (high is None or first <= high)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in (p for part in self.path.split(",") for p in listed(part.strip(), (".exr",))):
            parts, version, place = header_of(path)
            for number, attributes in enumerate(parts):
                plan = exr.plan_of(attributes, version, Limits())
                n = len(plan.regions)
                table = read_bytes(path, place, 8 * n)
                place += 8 * n
                if len(table) != 8 * n:
                    raise FormatError("exr", "TruncatedHeader", "offset table")
                offsets = struct.unpack(f"<{n}Q", table)
                order = sorted(range(n), key=offsets.__getitem__)
                own = [k for k in order if self.wanted(number, plan.regions[k])]
                after = dict(zip(order, (offsets[k] for k in order[1:]), strict=False))
                run, size, light = [], 0, replace(plan, regions=())
                for i, k in enumerate(own):
                    run.append((plan.regions[k], offsets[k]))
                    size += plan.size_of(plan.regions[k])
                    apart = i + 1 == len(own) or after.get(k) != offsets[own[i + 1]]
                    if apart or size >= self.bytes:
                        out.append(ChunkRun(path, number, bool(version & 0x1000), light, run, after.get(k)))
                        run, size = [], 0
        return out

    def wanted(self, number: int, region: tuple) -> bool:
        (i, j), x, y, w, h = region
        return self.within("part", number, number) and self.within("level_x", i, i) and self.within("level_y", j, j) and self.within("y", y, y + h - 1) and self.within("x", x, x + w - 1)

    def read(self, partition: ChunkRun | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands over where there are no partitions
            return
        start = partition.chunks[0][1]
        most = sum(partition.plan.size_of(r) + 24 for r, _ in partition.chunks)
        # A chunk is never longer than what it decodes to, so a wrong offset can't make a task read more than that.
        length = most if partition.end is None else min(most, partition.end - start)
        data = read_bytes(partition.path, start, length)
        held: list[tuple] = []
        count = 0
        for region, offset in partition.chunks:
            (i, j), *_ = region
            for channel, y, x, step, values in exr.chunk_rows(data, offset - start, partition.plan, partition.number, partition.multi, region):
                held.append((i, j, y, x + step * np.arange(len(values), dtype=np.int32), channel, values.astype(np.float64)))
                count += len(values)
                if count >= SAMPLES:
                    yield self.batch(partition, held)
                    held, count = [], 0
        yield self.batch(partition, held)

    @staticmethod
    def batch(partition: ChunkRun, held: list[tuple]) -> pa.RecordBatch:
        n = [len(v[3]) for v in held]
        each = lambda k: pa.array(np.repeat(np.array([v[k] for v in held], np.int32), n))
        total, names = sum(n), [v[4] for v in held]
        known = list(dict.fromkeys(names))
        places = np.repeat(np.array([known.index(c) for c in names], np.int32), n)
        flat = lambda k, kind: pa.array(np.concatenate([v[k] for v in held]) if held else np.empty(0, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array([partition.path] * total, pa.string()), pa.array(np.full(total, partition.number, np.int32)), each(0), each(1), each(2), flat(3, np.int32).cast(pa.int32()),
             pa.array(known, pa.string()).take(pa.array(places)), flat(5, np.float64)],
            ["path", "part", "level_x", "level_y", "y", "x", "channel", "value"],
        )


class ExrSource(DataSource):
    """spark.read.format("exr").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "exr"

    def schema(self) -> StructType | str:
        return "path string, part int, level_x int, level_y int, y int, x int, channel string, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ExrReader(self.options)
