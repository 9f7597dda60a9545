"""Crop, orientation, resampling and mip chains over pixel rows (image, y, x, channels...).

Crop and orientation are projections. Resampling is two joins with small tap tables (made from the two extents,
so their size doesn't depend on the number of images) and two sums; both sums have partial aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (axes swapped, sign of x, sign of y) of the eight orientations.
ORIENTATIONS = {
    "identity": (False, 1, 1), "flip_x": (False, -1, 1), "flip_y": (False, 1, -1), "rotate180": (False, -1, -1),
    "transpose": (True, 1, 1), "rotate90": (True, -1, 1), "rotate270": (True, 1, -1), "transverse": (True, -1, -1),
}


def crop(pixels: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """The rectangle, its origin moved to 0. The predicate reaches the scan."""
    inside = F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    return pixels.filter(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def map_window(pixels: DataFrame, dx: int, dy: int) -> DataFrame:
    """Moves the origin: a data window may lie anywhere, also at negative coordinates."""
    return pixels.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def oriented(x: Column, y: Column, width: Column | int, height: Column | int, name: str) -> tuple[Column, Column]:
    """Where a stored pixel goes when its orientation becomes the identity."""
    swap, sx, sy = ORIENTATIONS[name]
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    if not swap:
        return (x if sx == 1 else width - 1 - x), (y if sy == 1 else height - 1 - y)
    return (y if sx == 1 else height - 1 - y), (x if sy == 1 else width - 1 - x)


def orient(pixels: DataFrame, width: int, height: int, name: str) -> DataFrame:
    x, y = oriented(F.col("x"), F.col("y"), width, height, name)
    return pixels.withColumns({"x": x, "y": y})


def taps(source: int, target: int) -> list[tuple[int, int, float]]:
    """(target position, source position, weight) of a tent filter; weights of a target sum to 1."""
    scale = source / target
    radius = max(1.0, scale)
    out = []
    for d in range(target):
        centre = (d + 0.5) * scale - 0.5
        span = range(max(0, math.floor(centre - radius)), min(source - 1, math.ceil(centre + radius)) + 1)
        weighed = [(s, w) for s in span if (w := max(0.0, 1 - abs(s - centre) / radius)) > 0]
        total = sum(w for _, w in weighed)
        if total <= 0:
            weighed, total = [(min(source - 1, max(0, round(centre))), 1.0)], 1.0
        out += [(d, s, w / total) for s, w in weighed]
    return out


def resample(pixels: DataFrame, image: str, source: tuple[int, int], target: tuple[int, int], channels: list[str]) -> DataFrame:
    """(width, height) to (width, height), columns first, then rows. An axis that keeps its size is left alone."""
    spark, out = pixels.sparkSession, pixels
    for axis, other, a, b in (("x", "y", source[0], target[0]), ("y", "x", source[1], target[1])):
        if a == b:
            continue
        table = spark.createDataFrame(taps(a, b), f"_to int, {axis} int, _w double")  # b * (2 * scale + 2) rows at most
        joined = out.withColumn(axis, F.col(axis).cast("int")).join(F.broadcast(table), axis)
        sums = [F.sum(F.col(c) * F.col("_w")).alias(c) for c in channels]
        out = joined.groupBy(image, other, F.col("_to").alias(axis)).agg(*sums)
    return out


def halve(pixels: DataFrame, image: str, channels: list[str]) -> DataFrame:
    """The next mip level by 2 x 2 boxes."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return pixels.groupBy(image, half("y"), half("x")).agg(*(F.avg(c).alias(c) for c in channels))


def mip_chain(pixels: DataFrame, image: str, extent: int, channels: list[str]) -> DataFrame:
    """All levels of square images, each with a column `level`, by halving the level before."""
    levels, level, k = [pixels.withColumn("level", F.lit(0))], pixels, 0
    while extent > 1:
        level, extent, k = halve(level, image, channels), extent // 2, k + 1
        levels.append(level.withColumn("level", F.lit(k)))
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out
