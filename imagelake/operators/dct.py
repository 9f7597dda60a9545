"""8 x 8 discrete cosine transforms and quantisation as matrix products: joins with 64-row bases and sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The example luminance table of the JPEG standard, row order.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


def zigzag() -> list[int]:
    """Row-order places of the 64 coefficients in zig-zag order."""
    return [y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))]


def scaled_table(quality: int, table: tuple[int, ...] = LUMA) -> list[int]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [min(255, max(1, (v * scale + 50) // 100)) for v in table]


def basis(spark: SparkSession) -> DataFrame:
    """(k, n, c): orthonormal, c = s(k) cos((2n + 1) k pi / 16)."""
    rows = [(k, n, (math.sqrt(0.125) if k == 0 else 0.5) * math.cos((2 * n + 1) * k * math.pi / 16)) for k in range(8) for n in range(8)]
    return spark.createDataFrame(rows, "k int, n int, c double")


def transform(samples: DataFrame, image: str, inverse: bool = False) -> DataFrame:
    """(image, y, x, v) of 8 x 8 blocks -> the same columns with coefficients, or back."""
    b = basis(samples.sparkSession)
    into, from_ = ("n", "k") if inverse else ("k", "n")
    for axis, other in (("x", "y"), ("y", "x")):
        m = F.broadcast(b.select(F.col(from_).alias(axis), F.col(into).alias("_to"), "c"))
        samples = samples.join(m, axis).groupBy(image, other, F.col("_to").alias(axis)).agg(F.sum(F.col("v") * F.col("c")).alias("v"))
    return samples


def quantised(coefficients: DataFrame, quality: int = 90) -> DataFrame:
    """Adds q, the coefficient over its table entry rounded half to even, and zz, its place in zig-zag order."""
    spark, order = coefficients.sparkSession, zigzag()
    rows = [(p // 8, p % 8, zz, scaled_table(quality)[p]) for zz, p in enumerate(order)]
    table = F.broadcast(spark.createDataFrame(rows, "y int, x int, zz int, step int"))
    return coefficients.join(table, ["y", "x"]).withColumn("q", F.rint(F.col("v") / F.col("step")).cast("int"))


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luma and the two chroma differences of 8-bit RGB, level shifted by -128 for luma."""
    y = 0.299 * r + 0.587 * g + 0.114 * b - 128
    return y, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b
