"""Indexed images: palette lookup and quantising to a palette."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expand(indexed: DataFrame, palette: DataFrame, keys: list[str], index: str = "idx") -> DataFrame:
    """Equi-join on the index. A palette has at most 65,536 entries; Spark broadcasts it below its size limit and
    shuffles otherwise."""
    return indexed.join(palette, [*keys, index])


def build(pixels: DataFrame, keys: list[str], channels: list[str], largest: int = 256) -> DataFrame:
    """(keys, channels, idx) of images with at most `largest` colours, numbered by value; others have no rows."""
    colours = pixels.select(*keys, *channels).distinct()
    few = colours.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= largest).select(*keys)
    order = Window.partitionBy(*keys).orderBy(*channels)
    return colours.join(few, keys, "left_semi").withColumn("idx", F.row_number().over(order) - 1)


def _cells(pixels: DataFrame, keys: list[str], channels: list[str], bits: int) -> DataFrame:
    """The histogram of each image over cells of so many bits a channel: pixels and mean colour of each cell."""
    cell = {f"_{c}": F.floor(F.col(c) / (256 >> bits)).cast("int") for c in channels}
    sums = [F.avg(F.col(c).cast("double")).alias(c) for c in channels]
    return pixels.select(*keys, *channels).withColumns(cell).groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_n"), *sums)


def _nearest(palette: str, channels: list[str]) -> Column:
    """The place of the nearest colour of an array of structs; of equals the first."""
    distance = lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in channels[1:]), (F.col(channels[0]) - p[channels[0]]) * (F.col(channels[0]) - p[channels[0]]))
    return F.array_min(F.transform(palette, lambda p, i: F.struct(distance(p).alias("d"), i.alias("i"))))["i"]


def _palettes(cells: DataFrame, keys: list[str], channels: list[str], box: str) -> DataFrame:
    """(keys, palette): the mean colours of boxes of cells, in order of their values."""
    mean = cells.groupBy(*keys, box).agg(*((F.sum(F.col(c) * F.col("_n")) / F.sum("_n")).alias(c) for c in channels))
    return mean.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*(F.round(c, 6).alias(c) for c in channels)))).alias("palette"))


def adaptive(pixels: DataFrame, keys: list[str], channels: list[str], colours: int = 256, bits: int = 5, refine: int = 2) -> tuple[DataFrame, DataFrame]:
    """Palettes of at most `colours` (a power of two) for images of values 0..255, and the cells' places in them:
    (keys, palette: array of structs of channels) and (keys, _channel..., idx), for `indexed`.

    Pixels are met once, by a histogram of at most 2^(bits * channels) cells an image; all else works on cells. Boxes of
    cells are halved at their mean along the channel of the largest spread, all boxes of all images at once: one window
    a round, and a shuffle by image for all rounds together. Then `refine` rounds move each colour to the mean of the
    cells nearest to it. A box of one cell isn't halved, so an image of few colours has few."""
    cells = _cells(pixels, keys, channels, bits).repartition(*keys).withColumn("_box", F.lit(0).cast("long"))
    for _ in range((colours - 1).bit_length()):
        box = Window.partitionBy(*keys, "_box")
        total = F.sum("_n").over(box)
        mean = {c: F.sum(F.col(c) * F.col("_n")).over(box) / total for c in channels}
        spread = {c: F.sum(F.col(c) * F.col(c) * F.col("_n")).over(box) / total - mean[c] * mean[c] for c in channels}
        cells = cells.withColumns({f"_m{c}": mean[c] for c in channels} | {f"_v{c}": F.round(spread[c], 9) for c in channels})
        widest = F.array_max(F.array(*(F.struct(F.col(f"_v{c}").alias("v"), F.lit(-k).alias("k")) for k, c in enumerate(channels))))["k"]
        above = F.lit(False)
        for k, c in enumerate(channels):
            above = F.when(widest == -k, F.col(c) > F.col(f"_m{c}")).otherwise(above)
        cells = cells.withColumn("_box", F.col("_box") * 2 + above.cast("long")).drop(*(f"_{s}{c}" for s in "mv" for c in channels))
    made = _palettes(cells, keys, channels, "_box")
    for _ in range(refine):
        near = cells.drop("_box").join(made, keys).withColumn("_box", _nearest("palette", channels)).drop("palette")
        made = _palettes(near, keys, channels, "_box")
    places = cells.join(made, keys).select(*keys, *(f"_{c}" for c in channels), _nearest("palette", channels).alias("idx"))
    return made, places


def indexed(pixels: DataFrame, places: DataFrame, keys: list[str], channels: list[str], bits: int = 5) -> DataFrame:
    """pixels with idx, by the cells' places in an adaptive palette of the same bits."""
    cell = {f"_{c}": F.floor(F.col(c) / (256 >> bits)).cast("int") for c in channels}
    return pixels.withColumns(cell).join(places, [*keys, *cell]).drop(*cell)


def quantise(pixels: DataFrame, keys: list[str], channels: list[str], bits: int = 2) -> DataFrame:
    """Uniform quantisation to 2^bits levels a channel: idx and nothing to look up before."""
    level = lambda c: F.least(F.floor(F.col(c) / (256 >> bits)), F.lit((1 << bits) - 1)).cast("int")
    idx: Column = F.lit(0)
    for c in channels:
        idx = idx * (1 << bits) + level(c)
    return pixels.withColumn("idx", idx)
