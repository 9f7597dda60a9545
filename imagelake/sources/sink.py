"""`imagelake`, a data source that writes images as files: df.write.format("imagelake").option("to", "png").mode("append").save(folder)

A row is a whole image (path, width, height, channels, sample, samples and, if there, orientation), or with a column y a
band of its rows, from row y on. What a format's writer asks of the bands that reach it is its contract, and it is
enforced: bands of one image come together, in the contract's order, of its granularity, and cover the image; extents
and description are the same in all. A row that breaks it fails the job.

Tasks write below a folder of the job's own, beside the places that files will have. When all tasks are done, the driver
goes through their lists, some files at a time, refuses places that two files would take (and, but for overwrite mode, places that are
taken), before it moves the first file. If a task or the commit fails, the job's folder goes, and nothing else has been
touched; an attempt that a task repeats leaves nothing but what goes with that folder. Overwrite mode replaces files of
the same names only. The driver makes one move per file and holds eight bytes of each."""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from imagelake.sources.base import Codec, FormatError, Image
from imagelake.sources.files import at, exists, replace_file

NEEDED = ("path", "width", "height", "channels", "sample", "samples")
DTYPES = {"float16": np.float16, "float32": np.float32, "uint32": np.uint32, "unorm16": np.uint16}
#: Threads that move files when a job commits.
MOVERS = 16
#: Files of a list that a commit holds at once.
AT_ONCE = 1024


class ContractError(FormatError):
    """Rows that a writer's contract doesn't allow."""

    def __init__(self, codec: Codec, path: str, message: str):
        super().__init__(codec.format, "WriterContract", f"{path}: {message}")


class Assembly:
    """One image from its bands, held to its writer's contract."""

    def __init__(self, codec: Codec, row: dict):
        self.codec, self.head = codec, {k: row[k] for k in ("path", "width", "height", "channels", "sample")} | {"orientation": row.get("orientation") or "identity"}
        w, h, channels = row["width"], row["height"], row["channels"]
        if not channels or not w or not h or w <= 0 or h <= 0:
            raise self.broken("extents and channels come first")
        if row["sample"] not in codec.samples or (codec.channel_counts and len(channels) not in codec.channel_counts):
            raise self.broken(f"no {len(channels)} channels of {row['sample']}")
        if self.head["orientation"] != "identity" and not codec.orientation:
            raise self.broken(f"the format has no orientation, {self.head['orientation']} must be carried out before")
        self.samples = np.zeros((h, w, len(channels)), DTYPES.get(row["sample"], np.uint8))
        self.bands: list[tuple[int, int]] = []

    def broken(self, message: str) -> ContractError:
        return ContractError(self.codec, self.head["path"], message)

    def add(self, row: dict, samples: np.ndarray) -> None:
        c, (h, w, n) = self.codec.contract, self.samples.shape
        if any(row[k] != v for k, v in self.head.items() if k != "orientation") or (row.get("orientation") or "identity") != self.head["orientation"]:
            raise self.broken("bands differ in their description")
        if not len(samples) or len(samples) % (w * n):
            raise self.broken(f"{len(samples)} samples are no rows of {w} x {n}")
        first, rows = row.get("y") or 0, len(samples) // (w * n)
        last = first + rows
        if first < 0 or last > h:
            raise self.broken(f"rows {first} to {last - 1} of {h}")
        if not c.granularity and rows != h:
            raise self.broken("the writer takes whole images")
        if c.granularity and (first % c.granularity or (rows % c.granularity and last != h)):
            raise self.broken(f"bands have {c.granularity} rows, or a multiple")
        if self.bands and c.order == "increasing" and first != self.bands[-1][1] or not self.bands and c.order == "increasing" and first:
            raise self.broken(f"row {first} out of order")
        if any(first < b and a < last for a, b in self.bands):
            raise self.broken(f"row {first} comes twice")
        self.bands.append((first, last))
        self.samples[first:last] = samples.reshape(rows, w, n)

    def image(self) -> Image:
        if sum(b - a for a, b in self.bands) != len(self.samples):
            raise self.broken(f"{sum(b - a for a, b in self.bands)} of {len(self.samples)} rows came")
        return Image(self.codec.format, self.head["channels"], self.head["sample"], self.samples, orientation=self.head["orientation"])


def place_of(path: str, extension: str) -> str:
    """Where an image goes below the folder: its path without scheme and root, with the format's extension."""
    parts = [p for p in re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", "", path or "").split("/") if p not in ("", ".")]
    if not parts or ".." in parts:
        raise FormatError("any", "BadPath", repr(path))
    name = re.sub(r"(?<=.)\.[^.]*$", "", parts[-1])
    return "/".join((*parts[:-1], f"{name}.{extension}"))


@dataclass
class Written(WriterCommitMessage):
    listing: str
    files: int
    size: int


class ImageWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        from imagelake.sources.options import OptionError, parse

        missing = [c for c in NEEDED if c not in schema.fieldNames()]
        if missing:
            raise OptionError(f"columns {', '.join(missing)} are missing")
        if "path" not in options or "to" not in options:
            raise OptionError("a folder and the option `to` must be given")
        self.to, self.overwrite, self.folder = options["to"], overwrite, options["path"].rstrip("/")
        # Options of Spark come in lower case, as the formats' are.
        self.options = parse(self.to, tuple((k, v) for k, v in options.items() if k not in ("path", "to")))
        self.staging = f"{self.folder}/.imagelake-{uuid.uuid4().hex}"

    def images(self, batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[Image]:
        """Each image with its path, when its last band has come."""
        open_, seen = None, set()
        for b in batches:
            held = b.column("samples")
            for i, row in enumerate(b.select([c for c in b.schema.names if c in (*NEEDED, "orientation", "y") and c != "samples"]).to_pylist()):
                if open_ is None or row["path"] != open_.head["path"]:
                    if open_ is not None:
                        yield open_.head["path"], open_.image()
                    if hash(row["path"]) in seen:
                        raise ContractError(codec, row["path"], "its bands don't come together, or it comes twice")
                    seen.add(hash(row["path"]))
                    open_ = Assembly(codec, row)
                open_.add(row, held[i].values.to_numpy(zero_copy_only=False) if held[i].is_valid else np.empty(0))
        if open_ is not None:
            yield open_.head["path"], open_.image()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written | None:
        from imagelake.sources.catalog import REGISTRY

        codec = REGISTRY.codecs[self.to]
        fs, own = at(f"{self.staging}/{uuid.uuid4().hex}")
        fs.create_dir(own)
        try:
            n = size = 0
            with fs.open_output_stream(f"{own}/files") as listing:
                for path, image in self.images(iterator, codec):
                    content = codec.encode(image, **self.options)
                    with fs.open_output_stream(f"{own}/{n}") as out:
                        out.write(content)
                    listing.write((json.dumps([f"{own}/{n}", place_of(path, codec.extensions[0])]) + "\n").encode())
                    n, size = n + 1, size + len(content)
        except BaseException:
            fs.delete_dir(own)
            raise
        return Written(f"{own}/files", n, size)

    def listed(self, messages: list[Written | None]) -> Iterator[list[tuple[str, str]]]:
        """Files and their places, AT_ONCE at most at a time."""
        fs, _ = at(self.folder)
        for m in messages:
            if m is not None:
                with fs.open_input_stream(m.listing) as f, io.BufferedReader(f) as lines:
                    while files := [tuple(json.loads(line)) for line in islice(lines, AT_ONCE)]:
                        yield files

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = at(self.folder)
        seen, n = np.empty(sum(m.files for m in messages if m is not None), np.int64), 0
        for files in self.listed(messages):
            seen[n : n + len(files)] = [hash(place) for _, place in files]
            n += len(files)
            if not self.overwrite:
                taken = [f.path for f in fs.get_file_info([f"{folder}/{place}" for _, place in files]) if f.type.name != "NotFound"]
                if taken:
                    raise FileExistsError(f"{taken[0]} is there already")
        seen.sort()
        if (twice := np.flatnonzero(seen[1:] == seen[:-1])).size:
            place = next(place for files in self.listed(messages) for _, place in files if hash(place) == seen[twice[0]])
            raise FileExistsError(f"two images would become {place}")
        with ThreadPoolExecutor(MOVERS) as movers:
            for files in self.listed(messages):
                for parent in {f"{folder}/{place}".rpartition("/")[0] for _, place in files}:
                    fs.create_dir(parent)
                list(movers.map(lambda f: replace_file(fs, f[0], f"{folder}/{f[1]}"), files))
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, staging = at(self.staging)
        if exists(fs, staging):
            fs.delete_dir(staging)


class ImageSink(DataSource):
    """df.write.format("imagelake").option("to", FORMAT).save(folder); other options are those of the format."""

    @classmethod
    def name(cls) -> str:
        return "imagelake"

    def schema(self) -> str:
        return "path string, width int, height int, channels array<string>, sample string, samples array<double>"

    def writer(self, schema: StructType, overwrite: bool) -> ImageWriter:
        return ImageWriter(dict(self.options), schema, overwrite)
