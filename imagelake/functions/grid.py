"""Sample grids, block counts, mip levels and tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def on_grid(x: Column, origin: int, step: int) -> Column:
    return F.pmod(x - origin, F.lit(step)) == 0


def samples_in(low: Column, high: Column, origin: int, step: int) -> Column:
    """Grid points in [low, high); floor division, which also holds for negative coordinates."""
    below = lambda v: F.floor((v - origin - 1) / F.lit(float(step)))
    return (below(high) - below(low)).cast("long")


def clamp_to_sample(x: Column, low: Column, origin: int, step: int) -> Column:
    """The grid point at or before x, or the first one at or after `low` where that lies below the window."""
    at = x - F.pmod(x - origin, F.lit(step))
    return F.when(at < low, at + step).otherwise(at)


def ceil_div(a: Column, b: int | Column) -> Column:
    return F.ceil(a / b).cast("long")


def encoded_bytes(width: Column, height: Column, depth: Column, bw: int, bh: int, bd: int, bits: int) -> Column:
    return ceil_div(width, bw) * ceil_div(height, bh) * ceil_div(depth, bd) * bits / 8


def level_size(extent: Column, level: Column, round_up: bool = False) -> Column:
    scaled = extent / F.pow(F.lit(2.0), level.cast("double"))
    return F.greatest((F.ceil(scaled) if round_up else F.floor(scaled)).cast("long"), F.lit(1))


def level_count(extent: Column, round_up: bool = False) -> Column:
    """1 + floor (or ceil) of log2, by counting powers of two, so exact."""
    powers = F.sequence(F.lit(0), F.lit(40))
    size = lambda k: F.pow(F.lit(2.0), k.cast("double"))
    return F.size(F.filter(powers, lambda k: size(k) < extent if round_up else size(k) <= extent)) + (1 if round_up else 0)


def replicate(pixels: DataFrame, step_x: int, step_y: int, width: int, height: int) -> DataFrame:
    """Pixels stored at multiples of the steps only -> all of them. Each stored one is repeated over its cell, so nothing
    is joined or shuffled."""
    cell = lambda c, step, extent: F.explode(F.sequence(F.col(c), F.least(F.col(c) + (step - 1), F.lit(extent - 1))))
    return pixels.withColumn("y", cell("y", step_y, height)).withColumn("x", cell("x", step_x, width))


def fill(pixels: DataFrame, image: str, channels: list[str], step_x: int, step_y: int) -> DataFrame:
    """Channels that are null off their grid take the value at the grid point of their cell: one shuffle by cell."""
    zero = F.lit(0)
    cell = Window.partitionBy(image, clamp_to_sample(F.col("y"), zero, 0, step_y), clamp_to_sample(F.col("x"), zero, 0, step_x)).orderBy("y", "x")
    return pixels.withColumns({c: F.first(c, ignorenulls=True).over(cell.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in channels})


def row_offsets(rows: DataFrame, image: str, row: str, size: str, at: str = "at") -> DataFrame:
    """Byte offsets of rows whose sizes differ, as where a channel stands in some of them only: a running sum."""
    before = Window.partitionBy(image).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(at, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def sample_at(x: Column, y: Column, channel: Column, width: int, channels: int, bytes_each: int, planar_height: int | None = None) -> Column:
    """Byte offset of a sample: interleaved, or one plane of planar_height rows after the other."""
    if planar_height is None:
        return ((y * width + x) * channels + channel) * bytes_each
    return ((channel * planar_height + y) * width + x) * bytes_each


def unpack_bits(byte: Column, bits: int) -> Column:
    """The 8 / bits samples of a byte, highest bits first."""
    return F.array(*(F.shiftright(byte, 8 - bits * (i + 1)).bitwiseAND((1 << bits) - 1) for i in range(8 // bits)))


def pack_bits(samples: Column, bits: int) -> Column:
    """The byte of an array of samples, the first in the highest bits; absent ones are 0."""
    parts = [F.shiftleft(F.coalesce(F.get(samples, F.lit(i)), F.lit(0)).cast("int"), 8 - bits * (i + 1)) for i in range(8 // bits)]
    out = parts[0]
    for q in parts[1:]:
        out = out + q
    return out


def chunk_of(row: Column, first: int, lines: int) -> Column:
    """Number of the chunk that holds a row, where a chunk holds so many rows of a window that begins anywhere."""
    return F.floor((row - first) / lines).cast("int")
