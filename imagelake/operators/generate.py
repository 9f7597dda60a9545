"""Analytic test images as DataFrames: (y, x, r, g, b, a), integer formulas over a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERNS = ("flat", "ramp", "checker", "impulse", "stripes", "chroma", "alpha", "noise")


def _hash(x: Column, y: Column, channel: int) -> Column:
    """A counter hash of 32 bits, its top byte."""
    mask = 0xFFFFFFFF
    h = (x * 73_856_093).bitwiseXOR(y * 19_349_663).bitwiseXOR(F.lit(channel * 83_492_791 ^ 0x9E3779B9)).bitwiseAND(mask)
    for shift, factor in ((16, 0x45D9F3B), (15, 0x2C1B3C6D)):
        h = h.bitwiseXOR(F.shiftright(h, shift))
        # a product of 32 and 30 bits fits 63 when the left factor is halved into 16-bit parts
        low, high = h.bitwiseAND(0xFFFF), F.shiftright(h, 16)
        h = (low * factor + F.shiftleft((high * factor).bitwiseAND(0xFFFF), 16)).bitwiseAND(mask)
    return F.shiftright(h, 24)


def image(spark: SparkSession, pattern: str, width: int, height: int) -> DataFrame:
    px = spark.range(width * height).select(F.floor(F.col("id") / width).cast("long").alias("y"), (F.col("id") % width).alias("x"))
    x, y = F.col("x"), F.col("y")
    h, v = F.floor(255 * x / max(1, width - 1)), F.floor(255 * y / max(1, height - 1))
    full, zero = F.lit(255), F.lit(0)
    odd = lambda c: c.bitwiseAND(1) * 255
    band = F.floor(x / 8).cast("long").bitwiseAND(1) == 0
    made = {
        "flat": (F.lit(127), F.lit(127), F.lit(127), full), "ramp": (h, v, F.floor((h + v) / 2), full), "checker": (*(odd(x.bitwiseXOR(y)),) * 3, full),
        "impulse": (*(F.when((x == width // 2) & (y == height // 2), 255).otherwise(0),) * 3, full), "stripes": (odd(x), odd(y), odd(x + y), full),
        "chroma": (F.when(band, 255).otherwise(zero), F.when(band, 0).otherwise(128), F.when(band, 0).otherwise(255), full), "alpha": (h, v, 255 - h, h),
        "noise": (*(_hash(x, y, c) for c in range(3)), full),
    }[pattern]
    return px.select("y", "x", *(c.cast("int").alias(n) for c, n in zip(made, "rgba", strict=True)))
