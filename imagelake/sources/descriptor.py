"""Versioned descriptors of images as JSON, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "imagelake.descriptor/1"


def to_document(part: Column, version: str | Column = VERSION) -> Column:
    """JSON of a struct with the version beside it."""
    return F.to_json(F.struct((F.lit(version) if isinstance(version, str) else version).alias("version"), part.alias("part")))


def from_document(document: Column, part_schema: str) -> Column:
    """The struct of a document; null where it is none or of another version."""
    read = F.from_json(document, f"version string, part struct<{part_schema}>")
    return F.when(read["version"] == VERSION, read["part"])
