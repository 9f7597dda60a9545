"""Conversions of whole files: a plan per image, carried out on its samples, a file per row.

For folders of many files of all kinds and sizes: nothing is shuffled, a task holds one image. Images that share one
description, or are too large for a task, go through ImageFrame instead."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.operators.geometry import ORIENTATIONS, taps
from imagelake.plans.planner import Capabilities, Description, Plan, PlanError, gate, plan
from imagelake.sources.base import BROKEN, Image, Limits, described
from imagelake.sources.catalog import REGISTRY
from imagelake.sources.metadata import translated
from imagelake.sources.options import OPTIONS, OptionError, parse
from imagelake.sources.vp8 import Tables


@dataclass(frozen=True)
class Request:
    """What to make of each file. target_bytes: the best quality whose file is no larger."""

    to: str
    crop: tuple[int, int, int, int] | None = None
    resize: tuple[int, int] | None = None
    policy: str = "preview"
    encoding: str | None = None
    options: tuple[tuple[str, str], ...] = ()
    target_bytes: int | None = None
    tables: Tables | None = None  # of lossy WebP
    metadata: str = "drop"  # or keep: as the target's writer can say them

    def check(self) -> None:
        """Raises where no file could be converted as asked."""
        if self.to not in REGISTRY.codecs:
            raise OptionError(f"no format {self.to}")
        given = parse(self.to, self.options)
        if self.target_bytes is not None:
            if self.target_bytes <= 0:
                raise OptionError("the target size must be positive")
            if "quality" in given or not any(o.name == "quality" for o in OPTIONS[self.to]):
                raise OptionError(f"{self.to} has no quality to search for a target size")


@dataclass(frozen=True)
class Converted:
    content: bytes
    plan: Plan
    quality: int | None = None
    reached: bool | None = None


def describe(image: Image) -> Description:
    h, w, _ = image.samples.shape
    indexed = image.palette is not None
    spaces = tuple(entry[0] for entry in image.metadata)
    return Description(w, h, tuple(image.channels), image.sample, None, image.orientation, indexed, 8, parts=1 + max((k[0] for k in image.others), default=0), metadata=spaces)


def unit(v: np.ndarray, sample: str) -> np.ndarray:
    return v / ((1 << int(sample.removeprefix("unorm"))) - 1) if sample.startswith("unorm") else v.astype(np.float64)


def stored(v: np.ndarray, sample: str) -> np.ndarray:
    if sample.startswith("unorm"):
        top = (1 << int(sample.removeprefix("unorm"))) - 1
        return np.clip(np.rint(np.nan_to_num(v, nan=0.0) * top), 0, top).astype(np.uint8 if top < 256 else np.uint16)
    return v.astype(sample)


def resized(v: np.ndarray, width: int, height: int) -> np.ndarray:
    for axis, size in ((1, width), (0, height)):
        if v.shape[axis] != size:
            weights = np.zeros((size, v.shape[axis]))
            for d, s, w in taps(v.shape[axis], size):
                weights[d, s] += w
            v = np.moveaxis(np.tensordot(weights, v, (1, axis)), 0, axis)
    return v


def oriented(v: np.ndarray, name: str) -> np.ndarray:
    swap, sx, sy = ORIENTATIONS[name]
    v = v.swapaxes(0, 1) if swap else v
    return v[::sy, ::sx]


def carried_out(image: Image, p: Plan) -> Image:
    """The image after the steps of its plan; element encodings are the writer's part."""
    names = list(image.channels)
    indexed = any(s.name == "expand_indexed" for s in p.steps)
    v = image.samples if indexed else unit(image.samples, image.sample)
    for s in p.steps:
        if s.name == "expand_indexed":
            v, names = image.palette[v[:, :, 0].astype(np.int64)] / 255, list("RGBA")[: image.palette.shape[1]]
        elif s.name == "map_channels":
            rest = [c for c in names if c == "A"]
            v = np.concatenate([v[:, :, [names.index(s.args[0])] * len(s.args[1])], *(v[:, :, [names.index(c)]] for c in rest)], 2)
            names = [*s.args[1], *rest]
        elif s.name == "synthesize":
            v, names = np.concatenate((v, np.full((*v.shape[:2], 1), s.args[1])), 2), [*names, s.args[0]]
        elif s.name == "select_channels":
            v, names = v[:, :, [names.index(c) for c in s.args]], list(s.args)
        elif s.name == "crop":
            x, y, w, h = s.args
            v = v[y : y + h, x : x + w]
        elif s.name == "resample":
            v = resized(v, *s.args[2:])
        elif s.name == "orient":
            v = oriented(v, s.args[0])
        elif s.name not in ("select_part", "convert_sample", "drop_metadata", "preserve_metadata", "translate_metadata", "encode_elements"):
            raise PlanError(f"{s} isn't carried out on whole files")
    if not p.steps:
        return replace(image, others={}, metadata=[])
    # Writers pack elements from values of 0..1, and blocks from bytes.
    sample = "float32" if p.target.encoding and not p.target.encoding.startswith("bc") else p.target.sample
    return Image(image.format, names, sample, stored(v, sample), orientation=p.target.orientation)


def converted(data: bytes, request: Request, extension: str | None = None, limits: Limits = Limits()) -> Converted:
    reader, codec = REGISTRY.resolve(data[:16], extension), REGISTRY.codecs[request.to]
    source = reader.decode(data, limits, **({"tables": request.tables} if reader.format == "webp" else {}))
    p = plan(describe(source), Capabilities.of(codec), request.policy, request.encoding, request.resize, request.crop, request.metadata)
    image, options = carried_out(source, p), parse(request.to, request.options)
    if request.metadata == "keep":
        gone = {s.args[0] for s in p.steps if s.name == "drop_metadata"}
        kept, losses = translated([e for e in source.metadata if e[0] not in gone], request.to)
        p = replace(p, losses=p.losses + gate(request.policy, losses))
        image = replace(image, metadata=kept)
    if request.encoding:
        options["encoding"] = request.encoding
    if request.to == "webp":
        options["tables"] = request.tables
        if request.target_bytes is not None:
            options["lossless"] = False
    if request.target_bytes is None:
        return Converted(codec.encode(image, **options), p)
    scale = next(o for o in OPTIONS[request.to] if o.name == "quality")
    made = lambda q: codec.encode(image, **options | {scale.argument: q})
    # Sizes don't always grow with quality, so each one from the top is tried, but where its file is too large at its least.
    qualities = range(scale.high, scale.low - 1, -1)
    for q, least in zip(qualities, codec.least(image, qualities, **options) if codec.least else repeat(0)):
        if least <= request.target_bytes and len(tried := made(q)) <= request.target_bytes:
            return Converted(tried, p, q, True)
    return Converted(made(scale.low), p, scale.low, False)


_DDL = "content binary, steps string, losses string, quality int, reached boolean, error string"
_KINDS = (pa.binary(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string())
#: Bytes of converted files after which a batch is handed on.
HANDED_ON = 4 << 20


def _row(data: bytes | None, request: Request) -> tuple:
    """The columns of _DDL."""
    try:
        c = converted(data or b"", request)
        return c.content, "|".join(map(str, c.plan.steps)), ",".join(x.category for x in c.plan.losses), c.quality, c.reached, None
    except PlanError as e:
        return None, None, None, None, None, str(e)
    except BROKEN as e:
        return None, None, None, None, None, str(described(e))


def convert_files(files: DataFrame, request: Request, carry: tuple[str, ...] = ("path",), content: str = "content") -> DataFrame:
    """files (carry..., content) -> carry..., the converted content, its plan's steps and losses, the quality that a target
    size took, and the error where there is one."""
    return convert_chain(files, (request,), carry, content).drop("step")


def convert_chain(files: DataFrame, requests: Sequence[Request], carry: tuple[str, ...] = ("path",), content: str = "content") -> DataFrame:
    """files (carry..., content) -> a row for each file and request (step, from 0), with the columns of convert_files: the
    first request is of the file, each further one of the file made before it; after an error they fail too."""
    for request in requests:
        request.check()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, rows, held = [], [], 0
            for i in range(b.num_rows):
                data = b.column("_content")[i].as_py()
                for step, request in enumerate(requests):
                    rows.append((step, *_row(data, request)))
                    where.append(i)
                    data = rows[-1][1]
                    held += len(data or b"")
                if held >= HANDED_ON or i + 1 == b.num_rows:
                    made = (pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int32(), *_KINDS), strict=True))
                    at = pa.array(where, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in carry), *made], [*carry, "step", "content", "steps", "losses", "quality", "reached", "error"])
                    where, rows, held = [], [], 0

    source = files.select(*carry, F.col(content).alias("_content"))
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}step int, {_DDL}")


def placed(files: DataFrame, folder: str, extension: str) -> DataFrame:
    """files (path, ...) with place: the path below the files' common folder, below `folder`, with the new extension.
    Raises FileExistsError, before anything is written, where two files would take one place."""
    # All paths share what the smallest and the largest of them share.
    low, high = files.agg(F.min("path"), F.max("path")).head()
    shared = 0 if low is None else next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    root = "" if low is None else low[:shared].rpartition("/")[0] + "/"
    below = F.regexp_replace(F.expr(f"substring(path, {len(root) + 1})"), r"(?<=[^/])\.[^./]*$", "")
    out = files.withColumn("place", F.concat(F.lit(folder.rstrip("/") + "/"), below, F.lit(f".{extension}")))
    twice = out.groupBy("place").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").head(1)
    if twice:
        raise FileExistsError(f"{twice[0].a} and {twice[0].b} would both become {twice[0].place}")
    return out


def write_files(made: DataFrame) -> DataFrame:
    """Writes each content (path, place, content, error) at its place; returns path, place, bytes and the error. A file
    appears under its name when it is whole, and an older one stays until then; a place that can't be written is an error
    of its row."""
    from imagelake.sources.files import write_whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, sizes, errors = [], [], []
            for place, data, error in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                data = data.as_py()
                if data is not None:
                    try:
                        write_whole(place, data)
                    except OSError as e:
                        data, error = None, f"any: NotWritten: {e}"
                places.append(None if data is None else place)
                sizes.append(None if data is None else len(data))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(places, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["path", "place", "bytes", "error"])

    return made.select("path", "place", "content", "error").mapInArrow(run, "path string, place string, bytes long, error string")


def convert_folder(files: DataFrame, request: Request, folder: str) -> DataFrame:
    """files (path, content) converted and written below `folder`, their folders kept: path, place, bytes, error."""
    where = placed(files, folder, REGISTRY.codecs[request.to].extensions[0])
    return write_files(convert_files(where, request, ("path", "place")))
