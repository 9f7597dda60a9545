"""What codecs share: the decoded image, limits, errors and the registry."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np


class FormatError(ValueError):
    """A structured error: format, code, message and offset."""

    def __init__(self, fmt: str, code: str, message: str = "", offset: int | None = None):
        super().__init__(f"{fmt}: {code}: {message}" + (f" at {offset}" if offset is not None else ""))
        # A damaged file can name places that no column of longs holds.
        self.fmt, self.code, self.message, self.offset = fmt, code, message, offset if offset is not None and -(1 << 63) <= offset < 1 << 63 else None


#: What damaged data make a decoder raise. StopIteration is among them: within a generator it would end the task.
BROKEN = (ValueError, LookupError, TypeError, ArithmeticError, AttributeError, EOFError, MemoryError, RecursionError, StopIteration, struct.error, zlib.error)


def described(e: Exception) -> FormatError:
    """An error of BROKEN as a structured one."""
    if isinstance(e, FormatError):
        return e
    return FormatError("any", "LimitExceeded" if isinstance(e, MemoryError) else "MalformedData", f"{type(e).__name__}: {e}"[:200])


class AmbiguousFormat(ValueError):
    """Several formats fit equally well."""


@dataclass
class Image:
    """One decoded level: samples (height, width, channels) and what describes them. More levels, faces, array
    elements or parts stand in `others` as (part, element, face, level) -> samples."""

    format: str
    channels: list[str]
    sample: str
    samples: np.ndarray
    palette: np.ndarray | None = None
    metadata: list = field(default_factory=list)
    window: tuple[int, int] = (0, 0)
    orientation: str = "identity"
    encoding: str | None = None
    others: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Limits:
    dimension: int = 65_536
    pixels: int = 1 << 32
    decoded_bytes: int = 8 << 30
    working_bytes: int = 2 << 30
    parts: int = 1024
    channels: int = 1024
    levels: int = 32
    array_elements: int = 65_536
    ratio: int = 1000

    def check(self, width: int, height: int, bytes_per_pixel: int = 4, items: int = 1) -> None:
        if max(width, height) > self.dimension:
            raise FormatError("any", "LimitExceeded", f"{width} x {height}")
        if width * height * items > self.pixels or width * height * items * bytes_per_pixel > self.decoded_bytes:
            raise FormatError("any", "LimitExceeded", f"{width} x {height} x {items}")


class Budget:
    """Working memory of one decode: what is reserved beyond the limit raises, before anything is allocated."""

    def __init__(self, fmt: str, limit: int):
        self.fmt, self.limit, self.used, self.peak = fmt, limit, 0, 0

    def reserve(self, size: int) -> None:
        if size < 0 or size > self.limit - self.used:
            raise FormatError(self.fmt, "LimitExceeded", f"{self.used} + {size} bytes of working memory")
        self.used += size
        self.peak = max(self.peak, self.used)

    def release(self, size: int) -> None:
        self.used -= size


@dataclass(frozen=True)
class WriterContract:
    """What a writer of a format asks of the rows that reach it. granularity: rows that must come together, 0 for a
    whole image; order: of these groups."""

    granularity: int = 1
    order: str = "increasing"  # increasing, decreasing or arbitrary
    random_access: bool = False
    seekable: bool = False
    incomplete_levels: bool = False
    sparse: bool = False
    descriptor_first: bool = True
    extents_first: bool = True


@dataclass(frozen=True)
class Codec:
    """decode(bytes, Limits) -> Image; encode(Image, **options) -> bytes or None; probe(head) -> confidence 0 to 3;
    least(Image, qualities, **options) -> for each quality, bytes that the encoded file has at least."""

    format: str
    extensions: tuple[str, ...]
    probe: Callable[[bytes], int]
    decode: Callable[..., Image]
    encode: Callable[..., bytes] | None
    samples: tuple[str, ...]
    channel_counts: tuple[int, ...] | None = None
    encodings: tuple[str, ...] = ()
    arbitrary_names: bool = False
    multipart: bool = False
    orientation: bool = False
    indexed: bool = False
    big_endian: bool = False
    contract: WriterContract = WriterContract()
    metadata: tuple[str, ...] = ()  # namespaces that the writer emits, the one of texts last
    least: Callable[..., Iterator[int]] | None = None


class Registry:
    """Codecs by name. A new codec is added with register()."""

    def __init__(self) -> None:
        self.codecs: dict[str, Codec] = {}

    def register(self, codec: Codec) -> None:
        if codec.format in self.codecs:
            raise ValueError(f"{codec.format} is registered")
        self.codecs[codec.format] = codec

    def resolve(self, head: bytes, extension: str | None = None) -> Codec:
        """By the most confident probe; an extension decides between equals, or where no probe fits."""
        extension = (extension or "").lower().lstrip(".")
        scored = [(c.probe(head), c) for c in self.codecs.values()]
        top = max((s for s, _ in scored), default=0)
        best = [c for s, c in scored if s == top and top > 0]
        if len(best) == 1:
            return best[0]
        named = [c for c in best or self.codecs.values() if extension in c.extensions]
        if len(named) == 1:
            return named[0]
        if best:
            raise AmbiguousFormat(", ".join(c.format for c in best))
        raise FormatError("any", "UnknownFormat", extension or "no extension")
