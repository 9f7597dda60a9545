"""Texture blocks of 4 x 4 texels as DataFrame operations: one row per block with arrays of its texels.

Block statistics need only a block's own sixteen texels, so after one groupBy (or none, where a raster comes as
an array) everything is higher-order functions within the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.sources import texture


def to_blocks(pixels: DataFrame, image: str, value: str = "v") -> DataFrame:
    """(image, brow, bcol, texels): the sixteen values in row order."""
    brow, bcol = F.floor(F.col("y") / 4).cast("int"), F.floor(F.col("x") / 4).cast("int")
    slot = (F.col("y") % 4 * 4 + F.col("x") % 4).cast("int")
    texels = F.transform(F.array_sort(F.collect_list(F.struct(slot.alias("i"), F.col(value).alias("v")))), lambda t: t["v"])
    return pixels.groupBy(image, brow.alias("brow"), bcol.alias("bcol")).agg(texels.alias("texels"))


def encode_blocks(pixels: DataFrame, image: str, kind: str, channels: list[str]) -> DataFrame:
    """(image, y, x, channels 0..255) -> (image, brow, bcol, element): the bytes of each block. Texels beyond the image's
    edge repeat the last row and column."""
    brow, bcol = F.floor(F.col("y") / 4).cast("int"), F.floor(F.col("x") / 4).cast("int")
    texel = F.struct((F.col("y") % 4 * 4 + F.col("x") % 4).cast("int").alias("i"), *(F.col(c).cast("int").alias(c) for c in channels))
    grouped = pixels.groupBy(F.col(image), brow.alias("brow"), bcol.alias("bcol")).agg(F.collect_list(texel).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = b.column("_t"), b.num_rows
            flat = held.flatten()
            row = np.repeat(np.arange(n), np.diff(held.offsets.to_numpy()))
            at = flat.field(0).to_numpy()
            t = np.zeros((n, 16, len(channels)), np.int32)
            t[row, at] = np.stack([flat.field(1 + k).to_numpy() for k in range(len(channels))], 1)
            last_x, last_y = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.maximum.at(last_x, row, at % 4)
            np.maximum.at(last_y, row, at // 4)
            slot = np.arange(16)
            inside = np.minimum(slot // 4, last_y[:, None]) * 4 + np.minimum(slot % 4, last_x[:, None])
            raw = texture.encode_texels(kind, np.take_along_axis(t, inside[:, :, None], 1).astype(np.uint8))
            size = texture.SIZES[kind]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([raw[k * size : (k + 1) * size] for k in range(n)], pa.binary())], [image, "brow", "bcol", "element"])

    return grouped.mapInArrow(run, f"`{image}` {dict(pixels.dtypes)[image]}, brow int, bcol int, element binary")


def decode_blocks(elements: DataFrame, image: str, kind: str, channels: list[str], width: int, height: int) -> DataFrame:
    """(image, brow, bcol, element) -> (image, y, x, channels), without the texels beyond the image's edge. Values are 0..255,
    or doubles for half-float blocks."""
    kind_of, name = (np.float64, "double") if kind.startswith("bc6h") else (np.int32, "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            t = texture.decode_texels(kind, b"".join(b.column("element").to_pylist()), n).reshape(n * 16, -1)
            slot = np.tile(np.arange(16), n)
            y = np.repeat(b.column("brow").to_numpy(), 16) * 4 + slot // 4
            x = np.repeat(b.column("bcol").to_numpy(), 16) * 4 + slot % 4
            keep = np.flatnonzero((y < height) & (x < width))
            made = [pa.array(v[keep].astype(np.int32)) for v in (y, x)] + [pa.array(t[keep, k].astype(kind_of)) for k in range(len(channels))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep // 16)), *made], [image, "y", "x", *channels])

    ddl = f"`{image}` {dict(elements.dtypes)[image]}, y int, x int, " + ", ".join(f"`{c}` {name}" for c in channels)
    return elements.select(image, F.col("brow").cast("int"), F.col("bcol").cast("int"), "element").mapInArrow(run, ddl)


def idiv(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def bc4_palette(v0: Column, v1: Column) -> Column:
    """Eight values: six between the ends where v0 > v1, else four and then 0 and 255; divisions truncate."""
    six = [v0, v1] + [idiv((7 - i) * v0 + i * v1, 7) for i in range(1, 7)]
    four = [v0, v1] + [idiv((5 - i) * v0 + i * v1, 5) for i in range(1, 5)] + [F.lit(0), F.lit(255)]
    return F.when(v0 > v1, F.array(*six)).otherwise(F.array(*four))


def nearest(value: Column, palette: Column) -> Column:
    """Place of the nearest palette entry, the first of equal ones."""
    scored = F.transform(palette, lambda p, i: F.struct(F.abs(value - p).alias("d"), i.alias("i")))
    return F.array_min(scored)["i"]


def bc4_encode(blocks: DataFrame) -> DataFrame:
    """texels (0..255) -> v0 (largest), v1 (smallest), indices (sixteen of 0..7)."""
    ends = blocks.withColumns({"v0": F.array_max("texels"), "v1": F.array_min("texels")})
    ends = ends.withColumn("_p", bc4_palette(F.col("v0"), F.col("v1")))
    return ends.withColumn("indices", F.transform("texels", lambda t: nearest(t, F.col("_p")))).drop("_p")


def bc4_decode(blocks: DataFrame) -> DataFrame:
    palette = blocks.withColumn("_p", bc4_palette(F.col("v0"), F.col("v1")))
    return palette.withColumn("decoded", F.transform("indices", lambda i: F.get("_p", i))).drop("_p")


def bc2_alpha_encode(a: Column) -> Column:
    return F.least(F.lit(15), idiv(a + 8, 17))


def bc2_alpha_decode(code: Column) -> Column:
    return code * 17


def pack565(r: Column, g: Column, b: Column) -> Column:
    """Truncates, unlike the packed pixel formats."""
    return idiv(r, 8) * 2048 + idiv(g, 4) * 32 + idiv(b, 8)


def unpack565(word: Column) -> tuple[Column, Column, Column]:
    """The high bits repeat in the low ones."""
    r, g, b = idiv(word, 2048), idiv(word, 32) % 64, word % 32
    return r * 8 + idiv(r, 4), g * 4 + idiv(g, 16), b * 8 + idiv(b, 4)


def bc1_endpoints(blocks: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """color0 and color1 from arrays of sixteen texels: the farthest pair, the first of equal ones, larger word
    first. The 120 pairs stay within the row."""
    texels = F.arrays_zip(F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b"))
    square = lambda a, c, k: (a[k] - c[k]) * (a[k] - c[k])

    def farthest(t: Column) -> Column:
        pairs = F.flatten(
            F.transform(t, lambda p, i: F.transform(t, lambda q, j: F.struct((square(p, q, "r") + square(p, q, "g") + square(p, q, "b")).alias("d"), (-(i * 16 + j)).alias("first"), p.alias("p"), q.alias("q"))))
        )
        return F.array_max(pairs)

    found = blocks.withColumn("_t", texels).withColumn("_f", farthest(F.col("_t")))
    word = lambda k: pack565(F.col(f"_f.{k}.r"), F.col(f"_f.{k}.g"), F.col(f"_f.{k}.b"))
    return found.withColumns({"distance": F.col("_f.d"), "_a": word("p"), "_b": word("q")}).withColumns(
        {"color0": F.greatest("_a", "_b"), "color1": F.least("_a", "_b")}
    ).drop("_t", "_f", "_a", "_b")
