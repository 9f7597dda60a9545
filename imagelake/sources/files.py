"""Files and byte ranges of them, local or in any store that Arrow's file systems reach."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

#: Bytes of contents after which a batch is handed on.
HANDED_ON = 4 << 20


def at(uri: str) -> tuple[pafs.FileSystem, str]:
    m = re.match(r"file:/*(/.*)$", uri)
    return (pafs.LocalFileSystem(), m[1]) if m else pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def read_bytes(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, path = at(uri)
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)


def listed(uri: str, endings: tuple[str, ...]) -> list[str]:
    """The file itself, or the files of a folder with one of the endings, in order of their names."""
    fs, path = at(uri)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return [uri]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return [uri.rstrip("/") + f.path[len(path.rstrip("/")) :] for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and f.path.lower().endswith(endings)]


def _each(rows: DataFrame, make: Callable[[str], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """The rows that `make` gives for each text of one column, in batches of about HANDED_ON bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for b in batches:
            for text in b.column(0).to_pylist():
                for row in make(text):
                    made.append(row)
                    if len(made) * 256 >= HANDED_ON:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
                        made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, ddl)


def listing(spark: SparkSession, *folders: str) -> DataFrame:
    """(path) of all files below folders, listed by tasks: one lists a folder itself, others what is below each folder in
    it. The driver holds no list, which Spark's own file sources do."""

    def entries(uri: str, recursive: bool) -> Iterator[tuple[str, bool]]:
        fs, path = at(uri)
        for f in fs.get_file_info(pafs.FileSelector(path, recursive=recursive)):
            if f.type == pafs.FileType.File or not recursive:
                yield uri.rstrip("/") + f.path[len(path.rstrip("/")) :], f.type == pafs.FileType.Directory

    schema, ddl = pa.schema([("path", pa.string()), ("folder", pa.bool_())]), "path string, folder boolean"
    top = _each(spark.createDataFrame([(f,) for f in folders], "path string"), lambda uri: entries(uri, False), schema, ddl)
    below = top.filter("folder").select("path").repartition(spark.sparkContext.defaultParallelism, "path")
    return top.filter("not folder").unionByName(_each(below, lambda uri: entries(uri, True), schema, ddl)).select("path")


def contents(files: DataFrame) -> DataFrame:
    """All columns, path among them, and the content of files, each read by the task that has its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, made, size = 0, [], 0
            for i, uri in enumerate(b.column("path").to_pylist(), 1):
                made.append(read_bytes(uri))
                size += 256 + len(made[-1])
                if size >= HANDED_ON or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(made)).columns, pa.array(made, pa.binary())], [*b.schema.names, "content"])
                    first, made, size = i, [], 0

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def replace_file(fs: pafs.FileSystem, temporary: str, path: str) -> None:
    """Moves a whole file to its place. Most stores put it over an older one in one step; where one refuses, the older
    file is set aside first, and comes back if the move fails."""
    try:
        fs.move(temporary, path)
    except OSError:
        if not exists(fs, path) or not exists(fs, temporary):
            raise
        aside = f"{path}.{uuid.uuid4().hex}.old"
        fs.move(path, aside)
        try:
            fs.move(temporary, path)
        except OSError:
            fs.move(aside, path)
            raise
        fs.delete_file(aside)


def write_whole(uri: str, data: bytes) -> None:
    """Under a temporary name beside its own first, so that no half file is ever seen, and an older one stays till then."""
    fs, path = at(uri)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    fs.create_dir(path.rsplit("/", 1)[0])
    try:
        with fs.open_output_stream(temporary) as f:
            f.write(data)
        replace_file(fs, temporary, path)
    finally:
        if exists(fs, temporary):
            fs.delete_file(temporary)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have gone first
        return


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share, removed when the driver ends. Where that is
    unset, a session whose executors run on the driver's machine gets a folder of its own; any other is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="imagelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path
