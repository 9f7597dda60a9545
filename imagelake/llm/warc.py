"""WARC archives: writing, normalising monolithic gzip, reading by offset index.

* write_archives: each task streams its records into one whole-file gzip stream (one member).
* normalise_archives: inflates such a stream once, rewrites every record as a gzip member of its own and writes
  a sidecar index next to it: a line per record with offset, length, type, record id and target.
* sidecar_index: reads the sidecars back, in parallel.
* read_archives: opens each member at its offset; records can be read alone, whatever the archive's size.

Archives are dealt over tasks one by one for inflating, and their records by ranges of (archive, offset) for
reading. Files go below the shared folder under names that depend on the partition only; each is written under a
temporary name and takes its place when whole, so a task that runs again, or twice at once, leaves one whole file.
Beyond Arrow's batches, whose bytes Spark bounds, a task holds one record, or READ_BYTES of payloads read.

Defined results: a null html is an empty payload; a null url leaves out the target header; a null page_id
leaves out the page header, such a record is never referred to and revisits the response of its group if there
is one; of records that repeat the smallest page_id of their group all are responses; payloads below
`min_bytes` are always responses; an empty table gives no archive and an empty result; other columns are not
read. A truncated or damaged archive raises ValueError with the offset.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imagelake.llm.common import make_dir, scratch_path, table
from imagelake.llm.files import Placed, store

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 16
#: Payloads that a reading task gathers before it hands them on.
READ_BYTES = 8 << 20


# ---------------------------------------------------------------- records


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers]
    lines.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_safe(value: str) -> str:
    """Line ends and other controls can't stand in a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    headers = [("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
    headers += [("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", header_safe(url)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers.append(("Content-Type", "application/http; msgtype=response"))
    if not revisit:
        return record("response", headers, http + payload)
    to = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{digest}")
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{to}>"), ("X-Refers-To-Page", str(refers_to))]
    return record("revisit", headers, http)


def inflate(read, size: int = _CHUNK) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in parts; each member's checksum is verified."""
    engine, at, fresh = zlib.decompressobj(31), 0, True
    while data := read(size):
        while data:
            if fresh and not data.strip(b"\0"):  # padding between or after members
                at += len(data)
                break
            fresh = False
            try:
                part = engine.decompress(data)
            except zlib.error as e:
                raise ValueError(f"damaged gzip near byte {at}: {e}") from e
            if part:
                yield part
            at += len(data) - len(engine.unused_data)
            data = b""
            if engine.eof:
                data, engine, fresh = engine.unused_data, zlib.decompressobj(31), True
    if not fresh:
        raise ValueError(f"gzip ends within a member at byte {at}")


class Records:
    """Records of a stream of inflated parts: (head bytes, headers, block)."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.buffer, self.at = parts, bytearray(), 0

    def fill(self, n: int) -> bool:
        while len(self.buffer) < n:
            part = next(self.parts, None)
            if part is None:
                return False
            self.buffer += part
        return True

    def take(self, n: int) -> bytes:
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.at += n
        return out

    def __iter__(self) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
        while True:
            while self.fill(1) and self.buffer[:1] in (b"\r", b"\n"):
                self.take(1)
            if not self.buffer:
                return
            seen = 0
            while (end := self.buffer.find(b"\r\n\r\n", seen)) < 0:
                seen = max(0, len(self.buffer) - 3)
                if not self.fill(len(self.buffer) + 1):
                    raise ValueError(f"record at {self.at} ends within its headers")
            head = self.take(end + 4)
            headers = parse_headers(head, self.at)
            length = int(headers["content-length"])
            if not self.fill(length):
                raise ValueError(f"record before {self.at} ends within its block")
            yield head, headers, self.take(length)


def parse_headers(head: bytes, at: int = 0) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record near {at}: {first[:40]!r}")
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # a folded line
            out[name] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    if not out.get("content-length", "").isdigit():
        raise ValueError(f"record near {at} has no length")
    return out


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


# ---------------------------------------------------------------- archives


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) for the records that revisit another; only ids and digests move."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    small = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    small = table(small.filter(F.col("size") >= min_bytes).select("page_id", "digest"), "digests")
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null")
    # A table of its own on both sides of the join: Spark can split a digest that very many pages share.
    found = small.join(table(first.drop("n"), "firsts"), "digest")
    return table(found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct(), "revisits")


def write_archives(pages: DataFrame, where: str, min_bytes: int = 100, level: int = 4) -> DataFrame:
    """Writes pages (page_id, url, html) as monolithic archives below `where`; returns their paths."""
    r = revisits(pages, min_bytes).alias("r")
    html = F.coalesce("html", F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest")).alias("p")
    same = F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest"))
    rows = p.join(r, same, "left").select("p.page_id", "p.url", "p.html", "p.digest", F.col("r.refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(where)
        fs.create_dir(folder)
        out = packer = None
        for b in batches:
            for row in range(b.num_rows):
                page_id, url, html, digest, refers_to = (c[row].as_py() for c in b.columns)
                if out is None:
                    name = f"{folder}/mono-{TaskContext.get().partitionId():06d}.warc.gz"
                    out, packer = Placed(fs, name), zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE)], b"software: imagelake\r\n")))
                out.write(packer.compress(page_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, refers_to is not None)))
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [out.path]})

    return rows.mapInArrow(run, "path string")


def normalise_archives(paths: DataFrame, where: str, level: int = 6) -> DataFrame:
    """For each archive of `paths` a copy below `where` with a member per record and a sidecar index (.idx, tab
    separated); returns the copies' paths and numbers of records. A stream can't be entered in its middle, so an
    archive is one task's; as many tasks as there are shuffle partitions take them in turn."""
    make_dir(paths.sparkSession, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = store(where)
        for b in batches:
            made = []
            for path in b.column(0).to_pylist():
                source, inner = store(path)
                name = f"{folder}/{hashlib.sha256(path.encode()).hexdigest()[:16]}.warc.gz"
                out, index, n = Placed(fs, name), Placed(fs, name + ".idx"), 0
                with source.open_input_stream(inner, compression=None, buffer_size=_CHUNK) as f:
                    for head, headers, block in Records(inflate(f.read)):
                        offset, packer = out.size, zlib.compressobj(level, zlib.DEFLATED, 31)
                        out.write(packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush())
                        row = (offset, out.size - offset, headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-target-uri"))
                        index.write(("\t".join("" if v is None else str(v) for v in row) + "\n").encode())
                        n += 1
                out.close()
                index.close()
                made.append((name, n))
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in made], pa.string()), pa.array([v[1] for v in made], pa.int64())], ["path", "records"])

    return paths.repartition(_tasks(paths)).mapInArrow(run, "path string, records long")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sidecar_index(spark: SparkSession, where: str) -> DataFrame:
    """The rows of all sidecars below `where`: path, offset, length, record_type, record_id, target."""
    lines = spark.read.schema("value string").option("pathGlobFilter", "*.idx").text(where)
    cells = F.split("value", "\t", -1)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.idx$", 1)
    text = lambda i: F.nullif(cells[i], F.lit(""))
    return lines.select(
        F.concat(F.lit(where.rstrip("/") + "/"), name).alias("path"), cells[0].cast("long").alias("offset"), cells[1].cast("long").alias("length"),
        text(2).alias("record_type"), text(3).alias("record_id"), text(4).alias("target"),
    )


_PAGE_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


_PAGE = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())]
)


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_PAGE)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PAGE, strict=True)], schema=_PAGE)


def read_record(file, path: str, offset: int, length: int, texts: bool) -> tuple:
    """One record by its place. A response's payload is measured and digested again and must match its header; a
    revisit's figures are those of its header."""
    file.seek(offset)
    data = zlib.decompress(file.read(length), 31)
    end = data.index(b"\r\n\r\n") + 4
    headers = parse_headers(data[:end], offset)
    kind = headers["warc-type"]
    digest, size, html = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"]), None
    if kind == "response":
        payload = payload_of(data[end : end + int(headers["content-length"])])
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{path} at {offset}: the payload doesn't match its digest")
        html = payload.decode("utf-8", "replace") if texts else None
    page, to = headers.get("x-page-id"), headers.get("x-refers-to-page")
    return (int(page) if page else None, headers.get("warc-target-uri"), size, digest, kind, int(to) if to else None, html)


def read_archives(index: DataFrame, texts: bool = True) -> DataFrame:
    """Response and revisit records by their index rows (path, offset, length), in as many tasks as there are shuffle
    partitions: each takes a range of (path, offset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        for b in batches:
            rows, held = [], 0
            for path, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if path != open_path:
                    if file is not None:
                        file.close()
                    fs, inner = store(path)
                    open_path, file = path, fs.open_input_file(inner)
                rows.append(read_record(file, path, offset, length, texts))
                held += len(rows[-1][-1] or "")
                if held >= READ_BYTES:
                    yield _pages(rows)
                    rows, held = [], 0
            yield _pages(rows)
        if file is not None:
            file.close()

    wanted = index.filter("record_type in ('response', 'revisit')").select("path", "offset", "length")
    return wanted.repartitionByRange(_tasks(index), "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, _PAGE_DDL)


def archive_round_trip(pages: DataFrame, min_bytes: int = 100, texts: bool = False) -> DataFrame:
    """pages through monolithic archives, the normaliser and the index, back to one row per record."""
    where = scratch_path(pages.sparkSession, "warc")
    mono = table(write_archives(pages, f"{where}/mono", min_bytes), "archives")
    table(normalise_archives(mono, f"{where}/records"), "records")  # written, so that all sidecars are whole
    return read_archives(sidecar_index(pages.sparkSession, f"{where}/records"), texts)
