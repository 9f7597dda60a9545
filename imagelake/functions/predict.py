"""Byte prediction and reordering: one row per byte or sample, neighbours by windows.

A row's neighbours are read with lag over (image, row) or (image, column) within bands of rows, so a window never spans
more than an image row or a band's column; whole images never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = ("none", "sub", "up", "average", "paeth")
#: Rows of an image that go to one task together.
BAND = 64


def byte_delta(value: Column, previous: Column) -> Column:
    """(d[i] - d[i-1] + 128) mod 256; the first byte stays."""
    return F.when(previous.isNull(), value).otherwise(F.pmod(value - previous + 128, F.lit(256)))


def byte_undelta(delta: Column, order: Window) -> Column:
    """Inverse of byte_delta: a running sum, less 128 for every byte after the first."""
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return F.pmod(F.sum(delta).over(running) - 128 * (F.count(F.lit(1)).over(running) - 1), F.lit(256))


def split_position(i: Column, n: Column) -> Column:
    """Where byte i of n goes when even bytes are stored before odd ones."""
    return F.when(i % 2 == 0, F.floor(i / 2)).otherwise(F.ceil(n / 2) + F.floor(i / 2)).cast("long")


def paeth(left: Column, up: Column, corner: Column) -> Column:
    """The neighbour nearest to left + up - corner; ties in the order left, up, corner."""
    p = left + up - corner
    dl, du, dc = F.abs(p - left), F.abs(p - up), F.abs(p - corner)
    return F.when((dl <= du) & (dl <= dc), left).when(du <= dc, up).otherwise(corner)


def filtered(value: Column, left: Column, up: Column, corner: Column) -> dict[str, Column]:
    """Residuals mod 256 of the five row filters; missing neighbours are 0."""
    left, up, corner = (F.coalesce(c, F.lit(0)) for c in (left, up, corner))
    prediction = {"none": F.lit(0), "sub": left, "up": up, "average": F.floor((left + up) / 2), "paeth": paeth(left, up, corner)}
    return {k: F.pmod(value - p, F.lit(256)).cast("int") for k, p in prediction.items()}


def with_neighbours(samples: DataFrame, image: str, value: str = "v", step: int = 1) -> DataFrame:
    """Adds left, up and corner to (image, y, x, value): `step` samples to the left, one row up.

    Images are dealt out once, by bands of BAND rows; a band's last row goes to the next band as well, where it is only
    looked at. The three windows lie within a band, so they sort and don't shuffle."""
    band = F.floor(F.col("y") / BAND).cast("int")
    last = F.pmod(F.col("y"), F.lit(BAND)) == BAND - 1
    dealt = samples.withColumn("_band", F.explode(F.when(last, F.array(band, band + 1)).otherwise(F.array(band)))).repartition(image, "_band")
    row, column = Window.partitionBy(image, "_band", "y").orderBy("x"), Window.partitionBy(image, "_band", "x").orderBy("y")
    out = dealt.withColumn("left", F.lag(value, step).over(row)).withColumn("up", F.lag(value).over(column))
    return out.withColumn("corner", F.lag("up", step).over(row)).filter(F.col("_band") == band).drop("_band")


def least_entropy(samples: DataFrame, image: str, value: str = "v") -> DataFrame:
    """(image, entropy): over the rows of an image the mean of the least entropy, in bits, that a row filter leaves. High
    figures mean that no filter helps, and that storing is as good as packing."""
    near = with_neighbours(samples, image, value)
    residuals = filtered(F.col(value), F.col("left"), F.col("up"), F.col("corner"))
    each = near.select(image, "y", F.posexplode(F.array(*residuals.values())).alias("kind", "byte"))
    counts = each.groupBy(image, "y", "kind", "byte").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(image, "y", "kind").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    rows = sums.groupBy(image, "y").agg(F.min(F.log2("total") - F.col("s") / F.col("total")).alias("entropy"))
    return rows.groupBy(image).agg(F.avg("entropy").alias("entropy"))


def filter_scores(samples: DataFrame, image: str, value: str = "v") -> DataFrame:
    """(image, y, filter_id, score): sum of min(b, 256 - b) of each filter's residuals in each row."""
    near = with_neighbours(samples, image, value)
    residuals = filtered(F.col(value), F.col("left"), F.col("up"), F.col("corner"))
    cost = F.array(*(F.least(r, 256 - r) for r in residuals.values()))
    sums = near.groupBy(image, "y").agg(*(F.sum(cost[i]).alias(f"s{i}") for i in range(len(FILTERS))))
    return sums.select(image, "y", F.posexplode(F.array(*(f"s{i}" for i in range(len(FILTERS))))).alias("filter_id", "score"))


def best_filter(samples: DataFrame, image: str, value: str = "v") -> DataFrame:
    """The filter of smallest score per row, the first of equal ones."""
    return filter_scores(samples, image, value).groupBy(image, "y").agg(F.min(F.struct("score", "filter_id")).alias("b")).select(image, "y", F.col("b.filter_id").alias("filter_id"), F.col("b.score").alias("score"))


# Fixed values: (x0, y0, dx, dy) of the seven passes of an interlaced image.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def adam7_pass(x: Column, y: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, (x0, y0, dx, dy) in reversed(list(enumerate(ADAM7))):
        out = F.when((F.pmod(x - x0, F.lit(dx)) == 0) & (F.pmod(y - y0, F.lit(dy)) == 0), F.lit(k + 1)).otherwise(out)
    return out


def runs(samples: DataFrame, stream: str, order: str, value: str) -> DataFrame:
    """(stream, start, value, length) of runs of equal values: gaps and islands."""
    line = Window.partitionBy(stream).orderBy(order)
    fresh = F.when(F.lag(value).over(line).eqNullSafe(F.col(value)) & (F.row_number().over(line) > 1), 0).otherwise(1)
    island = samples.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(stream, "_run", value).agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length")).drop("_run")


def subtract_green(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    return F.pmod(r - g, F.lit(256)), F.pmod(b - g, F.lit(256))


def add_green(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    return F.pmod(r + g, F.lit(256)), F.pmod(b + g, F.lit(256))
