"""Filters of alpha planes: forward as expressions over pixel rows, backward by the decoder of the format."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.functions import predict, video
from imagelake.sources import webp


def filtered_planes(pixels: DataFrame, image: str) -> DataFrame:
    """(image, filter_kind, y, x, residual) for the kinds none, horizontal, vertical and gradient."""
    near = predict.with_neighbours(pixels, image)
    left, up, corner = (F.coalesce(F.col(c), F.lit(0)) for c in ("left", "up", "corner"))
    edge = lambda inner: F.when((F.col("x") == 0) & (F.col("y") == 0), 0).when(F.col("x") == 0, up).when(F.col("y") == 0, left).otherwise(inner)
    guesses = (F.lit(0), edge(left), edge(up), edge(video.gradient(left, up, corner)))
    each = F.array(*(F.struct(F.lit(k).alias("filter_kind"), F.pmod(F.col("v") - g, F.lit(256)).cast("int").alias("residual")) for k, g in enumerate(guesses)))
    return near.select(image, "y", "x", F.inline(each))


def restored_planes(residuals: DataFrame, image: str, width: int, height: int) -> DataFrame:
    """(image, filter_kind, y, x, restored)."""
    place = (F.col("y") * width + F.col("x")).cast("int")
    planes = residuals.groupBy(image, "filter_kind").agg(F.collect_list(F.struct(place.alias("i"), "residual")).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.divmod(np.arange(width * height, dtype=np.int32), width)
        for b in batches:
            for i in range(b.num_rows):
                plane = np.zeros(width * height, np.uint8)
                held = b.column(2)[i].values
                plane[held.field(0).to_numpy()] = held.field(1).to_numpy()
                kind = b.column(1)[i].as_py()
                out = webp.alpha_plane(bytes([kind << 2]) + plane.tobytes(), width, height).ravel().astype(np.int32)
                n = len(out)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n)), pa.array([kind] * n, pa.int32()), pa.array(y), pa.array(x), pa.array(out)], [image, "filter_kind", "y", "x", "restored"])

    return planes.mapInArrow(run, f"`{image}` {dict(residuals.dtypes)[image]}, filter_kind int, y int, x int, restored int")
