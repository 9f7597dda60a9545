"""Image files as a stream: new files below a folder are decoded as they arrive (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from imagelake.sources.catalog import decode_images


def image_stream(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame of path and decoded images; broken files carry an error struct."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(folder)
    )
    return decode_images(files)
