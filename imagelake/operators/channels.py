"""Channels as rows and as columns, and their canonical order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER, GREY = ("R", "G", "B", "A", "Y"), ("Y", "A")


def deinterleave(pixels: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """One row per sample: keys, channel, value. No shuffle."""
    return pixels.unpivot(keys, channels, "channel", "value")


def interleave(samples: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """One row per pixel with a column per channel; a channel that a pixel lacks is null."""
    wide = [F.max(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in channels]
    return samples.groupBy(*keys).agg(*wide)


def expand_grey(pixels: DataFrame, grey: str, alpha: Column | None, names: tuple[str, ...] = ("R", "G", "B")) -> DataFrame:
    """A grey column as three colour columns, and alpha (opaque where there is none)."""
    return pixels.withColumns({**{c: F.col(grey) for c in names}, "A": F.lit(255) if alpha is None else alpha})


def canonical(channels: Column, most: int = 4) -> Column:
    """An array of channel names in the order R, G, B, A, Y (Y, A for grey images), unknown names left out, at most `most`."""
    grey = F.size(F.array_except(channels, F.array(*map(F.lit, GREY)))) == 0
    order = F.when(grey, F.array(*map(F.lit, GREY))).otherwise(F.array(*map(F.lit, ORDER)))
    return F.slice(F.filter(order, lambda c: F.array_contains(channels, c)), 1, most)
