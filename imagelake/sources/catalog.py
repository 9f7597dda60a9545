"""The registered codecs, DataFrames of images, and the `imagelake` data source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from imagelake.sources import dds, exr, hdr, jpeg, png, webp
from imagelake.sources.base import BROKEN, Codec, FormatError, Image, Limits, Registry, WriterContract, described

REGISTRY = Registry()
for _codec in (
    Codec("png", ("png",), lambda h: 3 if h[:8] == png.SIGNATURE else 0, png.decode, png.encode, ("unorm1", "unorm2", "unorm4", "unorm8", "unorm16"), (1, 2, 3, 4), indexed=True, big_endian=True, contract=WriterContract(1), metadata=("png", "png.text")),
    Codec("jpeg", ("jpg", "jpeg"), lambda h: 3 if h[:3] == b"\xff\xd8\xff" else 0, jpeg.decode, jpeg.encode, ("unorm8",), (1, 3), big_endian=True, contract=WriterContract(0), metadata=("jpeg",), least=jpeg.least_sizes),
    Codec("exr", ("exr",), lambda h: 3 if h[:4] == exr.MAGIC else 0, exr.decode, exr.encode, ("float16", "float32", "uint32"), None, arbitrary_names=True, multipart=True, contract=WriterContract(16, "arbitrary", seekable=True), metadata=("exr",)),
    Codec("hdr", ("hdr", "pic"), lambda h: 3 if h[:10] == b"#?RADIANCE" else 2 if h[:6] == b"#?RGBE" else 0, hdr.decode, hdr.encode, ("float32",), (3,), ("rgbe",), orientation=True, contract=WriterContract(1), metadata=("hdr",)),
    Codec("dds", ("dds",), lambda h: 3 if h[:4] == b"DDS " else 0, dds.decode_dds, dds.encode_dds, ("unorm8", "unorm16", "float16", "float32"), (1, 2, 4), tuple(k for k, v in dds.FORMATS.items() if v[6]), contract=WriterContract(4)),
    Codec("ktx2", ("ktx2",), lambda h: 3 if h[:12] == dds.KTX2 else 0, dds.decode_ktx2, dds.encode_ktx2, ("unorm8", "unorm16", "float16", "float32"), (1, 2, 4), tuple(k for k, v in dds.FORMATS.items() if v[6] and v[1]), contract=WriterContract(0, "arbitrary", seekable=True), metadata=("ktx2",)),
    Codec("webp", ("webp",), lambda h: 3 if h[:4] == b"RIFF" and h[8:12] == b"WEBP" else 0, webp.decode, webp.encode, ("unorm8",), (3, 4), contract=WriterContract(0)),
):
    REGISTRY.register(_codec)

#: First bytes in hex and the format they name, for filters that stay in the JVM.
MAGIC = {"89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "762F3101": "exr", "233F52414449414E4345": "hdr", "233F52474245": "hdr", "44445320": "dds", "AB4B5458203230BB0D0A1A0A": "ktx2"}


def probe(content: Column) -> Column:
    """Format by first bytes as an expression; null where none fits."""
    head, out = F.hex(F.substring(content, 1, 12)), F.lit(None).cast("string")
    for magic, name in MAGIC.items():
        out = F.when(F.startswith(head, F.lit(magic)), F.lit(name)).otherwise(out)
    return F.when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), F.lit("webp")).otherwise(out)


def resolved(content: Column, extension: Column) -> Column:
    """Format of a file: by its first bytes, else by its extension. The formats' first bytes exclude each other."""
    named = F.lit(None).cast("string")
    for codec in REGISTRY.codecs.values():
        named = F.when(F.ltrim(F.lower(extension), F.lit(".")).isin(*codec.extensions), F.lit(codec.format)).otherwise(named)
    return F.coalesce(probe(content), named)


def outcome(error: Column) -> Column:
    """What became of a decode: accepted, unsupported, resource_limit or rejected."""
    code = error["code"]
    return F.when(error.isNull(), "accepted").when(code == "LimitExceeded", "resource_limit").when(code.startswith("Unsupported."), "unsupported").otherwise("rejected")


def compared(ours: Column, other: Column) -> Column:
    """Two decoders' outcomes of one file; a null one was not asked."""
    unsure = F.array(F.lit("unsupported"), F.lit("resource_limit"))
    return (
        F.when((ours == "crash") | F.coalesce(other == "crash", F.lit(False)), "failure").when(other.isNull(), "not_compared")
        .when(F.array_contains(unsure, ours) | F.array_contains(unsure, other), "inconclusive").when(ours == other, "agreement").otherwise("acceptance_mismatch")
    )


IMAGE_SCHEMA = (
    "format string, width int, height int, channels array<string>, sample string, encoding string, orientation string, "
    "samples array<double>, error struct<format string, code string, message string, offset long>"
)


def image_row(content: bytes | None, extension: str | None, limits: Limits, options: dict | None = None) -> tuple:
    """A row of IMAGE_SCHEMA; broken images give an error struct in place of samples. options: of decoders, by format."""
    try:
        codec = REGISTRY.resolve((content or b"")[:16], extension)
        im = codec.decode(content, limits, **(options or {}).get(codec.format, {}))
        h, w, _ = im.samples.shape
        return im.format, w, h, im.channels, im.sample, im.encoding, im.orientation, im.samples.astype(np.float64).ravel(), None
    except BROKEN as e:
        e = described(e)
        return None, None, None, None, None, None, None, None, (e.fmt, e.code, e.message, e.offset)


#: Samples of decoded images after which a batch is handed on.
HANDED_ON = 1 << 17


def decode_images(files: DataFrame, content: str = "content", extension: str | None = None, limits: Limits = Limits(), carry: tuple[str, ...] = ("path",), options: dict | None = None) -> DataFrame:
    """files (carry..., content) -> carry... and IMAGE_SCHEMA. A task holds one batch of files, and one image besides some
    small ones. options: of decoders, by format, as {"webp": {"tables": ...}}."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(IMAGE_SCHEMA)
    arrow = pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, rows, held = [], [], 0
            for i in range(b.num_rows):
                rows.append(image_row(b.column("_content")[i].as_py(), extension, limits, options))
                where.append(i)
                held += 0 if rows[-1][7] is None else len(rows[-1][7])
                if held >= HANDED_ON or i + 1 == b.num_rows:
                    columns = [[v if not isinstance(v, tuple) else dict(zip(("format", "code", "message", "offset"), v, strict=True)) for v in c] for c in zip(*rows, strict=True)]
                    at = pa.array(where, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in carry), *(pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True))], [*carry, *(f.name for f in arrow)])
                    where, rows, held = [], [], 0

    source = files.select(*carry, F.col(content).alias("_content"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), IMAGE_SCHEMA])
    return source.mapInArrow(run, ddl)


def mips(v: np.ndarray) -> list[np.ndarray]:
    """Half sizes by means of 2 x 2, down to one pixel; odd extents repeat their last row or column."""
    out = []
    while max(v.shape[:2]) > 1:
        h, w = v.shape[:2]
        padded = np.pad(v, ((0, h % 2 if h > 1 else 1), (0, w % 2 if w > 1 else 1), (0, 0)), mode="edge").astype(np.float64)
        mean = padded.reshape(padded.shape[0] // 2, 2, padded.shape[1] // 2, 2, -1).mean((1, 3))[: max(1, h // 2), : max(1, w // 2)]
        v = (np.rint(mean) if v.dtype.kind == "u" else mean).astype(v.dtype)
        out.append(v)
    return out


def decode_levels(files: DataFrame, content: str = "content", limits: Limits = Limits(), carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """carry..., part, element, face, level_x, level_y, width, height, channels, samples: a row for each subresource of files
    that decode; others have none."""
    kinds = [pa.int32()] * 7 + [pa.list_(pa.string()), pa.list_(pa.float64())]
    names = ["part", "element", "face", "level_x", "level_y", "width", "height", "channels", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("_content")[i].as_py() or b""
                try:
                    im = REGISTRY.resolve(data[:16]).decode(data, limits)
                except BROKEN:
                    continue
                for (part, element, face, level), v in ({(0, 0, 0, 0): im.samples} | im.others).items():
                    x, y = level if isinstance(level, tuple) else (level, level)
                    row = part, element, face, x, y, v.shape[1], v.shape[0], im.channels, v.astype(np.float64).ravel()
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in carry), *(pa.array([c], k) for c, k in zip(row, kinds, strict=True))], [*carry, *names])

    source = files.select(*carry, F.col(content).alias("_content"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}, part int, element int, face int, level_x int, level_y int, width int, height int, channels array<string>, samples array<double>")


def encode_images(images: DataFrame, fmt: str, options: dict | None = None, carry: tuple[str, ...] = ("path",), with_mips: bool = False, texts: str | None = None) -> DataFrame:
    """Rows of IMAGE_SCHEMA -> carry..., content and error; with all mip levels in formats that hold them. texts: a column
    with a map of names, as PNG has them, to texts; one that the format can't hold is an error of its row."""
    from imagelake.sources.metadata import translated

    codec, options = REGISTRY.codecs[fmt], options or {}
    kinds = {"float16": np.float16, "float32": np.float32, "uint32": np.uint32, "unorm16": np.uint16}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, bad = [], []
            held = b.column("samples")
            for i, r in enumerate(b.drop_columns(["samples"]).to_pylist()):  # samples stay in Arrow's buffers
                try:
                    if not held[i].is_valid:
                        raise FormatError(fmt, "NoImage")
                    v = held[i].values.to_numpy(zero_copy_only=False).reshape(r["height"], r["width"], len(r["channels"])).astype(kinds.get(r["sample"], np.uint8))
                    others = {(0, 0, 0, k): m for k, m in enumerate(mips(v), 1)} if with_mips else {}
                    said, lost = translated([("text", k, t) for k, t in r[texts] or () if t is not None], fmt) if texts else ([], [])
                    for x in lost:
                        if x.semantic:
                            raise FormatError(fmt, "Unsupported.Metadata", x.message)
                    out.append(codec.encode(Image(fmt, r["channels"], r["sample"], v, orientation=r["orientation"] or "identity", others=others, metadata=said), **options))
                    bad.append(None)
                except BROKEN as e:
                    out.append(None)
                    bad.append(str(described(e)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(out, pa.binary()), pa.array(bad, pa.string())], [*carry, "content", "error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields if f.name in carry)
    needed = images.select(*carry, "width", "height", "channels", "sample", "orientation", "samples", *([texts] if texts else []))
    return needed.mapInArrow(run, f"{ddl}, content binary, error string")


def to_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, y, x, channel, value): one row per sample, by built-in generators."""
    n = F.size("channels")
    flat = images.filter("samples is not null").select(key, "width", "channels", n.alias("n"), F.posexplode("samples").alias("i", "value"))
    return flat.select(
        key, F.floor(F.col("i") / F.col("n") / F.col("width")).cast("long").alias("y"), (F.floor(F.col("i") / F.col("n")) % F.col("width")).cast("long").alias("x"),
        F.get("channels", F.col("i") % F.col("n")).alias("channel"), "value",
    )


# ---------------------------------------------------------------- data source


#: Texels of a batch that the data source hands on.
TEXELS = 1 << 15


class _Band(InputPartition):
    def __init__(self, path: str, level: int, at: int, stored: int, inner: tuple):
        self.path, self.level, self.at, self.stored, self.inner = path, level, at, stored, inner


class TextureReader(DataSourceReader):
    """Rows (path, element, face, level, y, x, channel, value) of DDS and KTX2 files: one, several divided by commas, or
    all of a folder. The header says where each subresource lies, so each is a partition of its own, and equality
    filters on element, face or level leave partitions out. The driver reads headers only."""

    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], {}

    def pushFilters(self, filters):
        for f in filters:
            if type(f).__name__ == "EqualTo" and f.attribute[0] in ("element", "face", "level"):
                self.wanted[f.attribute[0]] = f.value
            yield f  # Spark filters again; leaving partitions out is all that happens here

    def partitions(self):
        from imagelake.sources.files import listed, read_bytes

        out = []
        for path in (p for part in self.path.split(",") for p in listed(part.strip(), (".dds", ".ktx2"))):
            data = read_bytes(path, 0, 4096)
            if dds.header_bytes(data) > len(data):  # a KTX2 header holds metadata of any size
                data = read_bytes(path, 0, dds.header_bytes(data))
            layout = dds.dds_layout(data) if data[:4] == b"DDS " else dds.ktx2_layout(data)
            for key, (at, stored, packed) in layout.places():
                place = dict(zip(("element", "face", "level"), key, strict=False))
                if all(place[k] == v for k, v in self.wanted.items()):
                    out.append(_Band(path, key[2], at, stored, (layout.name, key, packed, *layout.size(key[2]), layout.bytes_of(key[2]))))
        return out

    def read(self, partition):
        import zlib

        from imagelake.sources.files import read_bytes

        name, key, packed, w, h, d, size = partition.inner
        raw = read_bytes(partition.path, partition.at, partition.stored)
        if packed:
            raw = zlib.decompress(raw)[key[3] :][:size]
        samples = dds.elements_to_samples(name, raw, w, h, d)
        rows, width, n = samples.shape
        channels, per = np.array(list(dds.FORMATS[name][2])), max(1, TEXELS // width)
        for first in range(0, rows, per):  # batches of some rows, so that a large subresource isn't held twice
            part = samples[first : first + per]
            y, x, c = (v.ravel() for v in np.indices(part.shape, np.int32))
            fixed = [pa.array([v] * len(y), kind) for v, kind in ((partition.path, pa.string()), (key[0], pa.int32()), (key[1], pa.int32()), (key[2], pa.int32()))]
            made = [pa.array(y + np.int32(first)), pa.array(x), pa.array(channels[c].tolist(), pa.string()), pa.array(part.astype(np.float64).ravel())]
            yield pa.RecordBatch.from_arrays([*fixed, *made], ["path", "element", "face", "level", "y", "x", "channel", "value"])


class TextureSource(DataSource):
    """spark.read.format("texture").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "texture"

    def schema(self) -> StructType | str:
        return "path string, element int, face int, level int, y int, x int, channel string, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TextureReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the sources `texture` and `exr` and the sink `imagelake` known."""
    from imagelake.sources.exrsource import ExrSource
    from imagelake.sources.sink import ImageSink

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TextureSource, ExrSource, ImageSink):
        spark.dataSource.register(source)


def png_chunks(files: DataFrame, carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """(carry..., ordinal, type, length, payload, crc) of PNG files; files that break off give the chunks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, rows = [], []
            for i, data in enumerate(b.column("_content").to_pylist()):
                try:
                    for n, kind, payload, crc in png.chunks(data or b""):
                        where.append(i)
                        rows.append((n, kind, len(payload), payload, crc))
                except FormatError:
                    continue
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
            at = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in carry), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*carry, "ordinal", "type", "length", "payload", "crc"])

    source = files.select(*carry, F.col("content").alias("_content"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}, ordinal int, type string, length long, payload binary, crc long")


def png_metadata(files: DataFrame, carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """(carry..., namespace, key, value) of PNG files: texts as they read, profiles in hex, figures as numbers; a broken
    file has no rows."""
    shown = lambda v: v.hex() if isinstance(v, bytes) else " ".join(map(repr, v)) if isinstance(v, list) else v if isinstance(v, str) else repr(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, rows = [], []
            for i, data in enumerate(b.column("_content")):
                try:
                    found = png.document(data.as_py() or b"", Limits()).metadata
                except BROKEN:
                    continue
                where += [i] * len(found)
                rows += [(space, key, shown(value)) for space, key, value in found]
            at, columns = pa.array(where, pa.int64()), list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in carry), *(pa.array(c, pa.string()) for c in columns)], [*carry, "namespace", "key", "value"])

    source = files.select(*carry, F.col("content").alias("_content"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{ddl}, namespace string, key string, value string")
