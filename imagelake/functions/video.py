"""Fixed-point colour of lossy key frames, and rules of its encoder, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(16839 * r + 33059 * g + 6420 * b + 32768, 16) + 16


def chroma(r4: Column, g4: Column, b4: Column) -> tuple[Column, Column]:
    """U and V of sums over four pixels."""
    u = F.shiftright(-9719 * r4 - 19081 * g4 + 28800 * b4 + 131072, 18) + 128
    return u, F.shiftright(28800 * r4 - 24116 * g4 - 4684 * b4 + 131072, 18) + 128


def quantiser(quality: Column) -> Column:
    return F.floor((127 * (100 - quality) + 50) / 100).cast("int")


def gradient(left: Column, up: Column, corner: Column) -> Column:
    return F.least(F.greatest(left + up - corner, F.lit(0)), F.lit(255))


def jpeg_step(base: Column, quality: Column) -> Column:
    """A quantisation step scaled by quality; integer divisions."""
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    return F.least(F.greatest(F.floor((base * scale + 50) / 100), F.lit(1)), F.lit(255)).cast("int")


def restart_interval(units: Column, nonzero: Column, segments: int) -> Column:
    """Units between restart markers, 0 for none: at least 4 units and 8,192 nonzero coefficients a segment."""
    n = F.least(F.floor(units / 4), F.lit(segments), F.greatest(F.lit(1), F.floor(nonzero / 8192)))
    return F.when((units <= 4) | (n <= 1), F.lit(0)).otherwise(F.ceil(units / n)).cast("int")
