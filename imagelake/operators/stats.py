"""Quality figures, histograms, rankings and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def error_report(pairs: DataFrame, group: list[str], a: str, b: str, peak: float = 255.0) -> DataFrame:
    """mse, psnr (null for equal images), max_error, differing, samples of each group."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    out = pairs.groupBy(*group).agg(
        F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_error"), F.count_if(d != 0).alias("differing"), F.count(F.lit(1)).alias("samples")
    )
    return out.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(peak * peak) / F.col("mse"))))


def passes_quality(size: Column, peer: Column, mse: Column, peer_mse: Column, lossless: Column, limit: float = 1.2) -> Column:
    """Not much larger than the peer; a lossless pair without error, a lossy one with little more than the peer's."""
    return (size <= limit * peer) & F.when(lossless, (mse == 0) & (peer_mse == 0)).otherwise(mse <= 1.25 * peer_mse + 2)


def geometric_mean(c: Column) -> Column:
    """exp(avg(ln)); any value that isn't positive and finite makes it null."""
    good = (c > 0) & (c < float("inf"))
    return F.when(F.bool_and(good), F.exp(F.avg(F.ln(F.when(good, c)))))


def entropy(samples: DataFrame, group: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of the values of each group."""
    counts = samples.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.groupBy(*group).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.log2("_n")).alias("_s"), F.count(F.lit(1)).alias("distinct_values"))
    return sums.select(*group, "n", "distinct_values", (F.log2("n") - F.col("_s") / F.col("n")).alias("entropy"))


def complete_groups(measured: DataFrame, group: list[str], item: str, items: DataFrame) -> DataFrame:
    """Groups that have every item (relational division). items: one row per wanted item."""
    wanted = items.select(item).distinct()
    have = measured.join(wanted, item, "left_semi").groupBy(*group).agg(F.count_distinct(item).alias("_n"))
    return have.join(wanted.agg(F.count(F.lit(1)).alias("_all")), F.col("_n") == F.col("_all")).select(*group)


def pareto(points: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Points of a group that no other one dominates (no worse in both, better in one). Sorted by a then b a point
    stays if its b is below that of all before, or equal to the best among points that share both; one sort
    in place of a join of each point with each other."""
    best = points.groupBy(group, a).agg(F.min(b).alias("_b"))
    line = Window.partitionBy(group).orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("_before", F.min("_b").over(line)).filter(F.col("_before").isNull() | (F.col("_b") < F.col("_before")))
    return points.alias("p").join(
        front.alias("f"), (F.col(f"p.{group}") == F.col(f"f.{group}")) & (F.col(f"p.{a}") == F.col(f"f.{a}")) & (F.col(f"p.{b}") == F.col("f._b")), "left_semi"
    )


def rank_with_ties(rows: DataFrame, group: list[str], by: Column) -> Column:
    return F.rank().over(Window.partitionBy(*group).orderBy(by))


def banded(points: DataFrame, group: str, first: str, tolerance: float) -> DataFrame:
    """points with `band`: of a group, band 1 holds all within the tolerance of the best `first`, band 2 all within that
    of the best left, and so on. A group's distinct values pass through one aggregate: meant for the rows of a report."""
    values = points.groupBy(group).agg(F.array_sort(F.collect_set(F.col(first).cast("double"))).alias("_v"))
    start = F.struct(F.lit(-1.0).alias("top"), F.lit(0).alias("band"), F.array().cast("array<struct<v:double,band:int>>").alias("out"))

    def step(state: Column, v: Column) -> Column:
        fresh = (state["band"] == 0) | (v > state["top"])
        band = F.when(fresh, state["band"] + 1).otherwise(state["band"])
        top = F.when(fresh, v * (1 + tolerance)).otherwise(state["top"])
        return F.struct(top.alias("top"), band.alias("band"), F.array_append(state["out"], F.struct(v.alias("v"), band.alias("band"))).alias("out"))

    bands = values.select(group, F.explode(F.aggregate("_v", start, step, lambda s: s["out"])).alias("_b"))
    bands = bands.select(group, F.col("_b.v").alias("_first"), F.col("_b.band").alias("band"))
    return points.join(bands, (points[group] == bands[group]) & (points[first].cast("double") == bands["_first"])).select(points["*"], "band")


def tradeoff_order(points: DataFrame, group: str, first: str, second: str, tolerance: float, names: list[str]) -> DataFrame:
    """points with `band` of their `first` and `place` in their group: bands in order, within one the best `second`, then
    the best `first`, then the smallest names."""
    order = Window.partitionBy(group).orderBy("band", second, first, *names)
    return banded(points, group, first, tolerance).withColumn("place", F.row_number().over(order))


def metadata_report(entries: Column, size: str = "size", namespace: str = "ns") -> dict[str, Column]:
    """Figures over an array of metadata entries: total and largest size, whether any or all belong to a namespace, the
    namespaces once each, those besides text, and the first two by size."""
    names = F.array_distinct(F.transform(entries, lambda e: e[namespace]))
    text = lambda e: e[namespace] == "text"
    largest = F.transform(F.slice(F.reverse(F.array_sort(F.transform(entries, lambda e: F.struct(e[size].alias("s"), e[namespace].alias("n"))))), 1, 2), lambda e: e["s"])
    return {
        "total": F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e[size]), "largest": F.array_max(F.transform(entries, lambda e: e[size])),
        "any_text": F.exists(entries, text), "all_text": F.forall(entries, text), "names": F.array_join(F.array_sort(names), ","),
        "other_names": F.array_join(F.array_sort(F.array_except(names, F.array(F.lit("text")))), ","), "top_two": F.array_join(F.transform(largest, lambda v: v.cast("string")), ","),
    }


def violations(assets: DataFrame, limits: dict[str, int]) -> Column:
    """Names of the limits that a row's figures exceed; a product of extents beyond 63 bits is one as well."""
    pixels = F.col("width").cast("decimal(38,0)") * F.col("height").cast("decimal(38,0)")
    tests = {
        "parts": F.col("parts") > limits["parts"],
        "channels": F.col("channels") > limits["channels"],
        "dimension": F.greatest("width", "height") > limits["dimension"],
        "pixels": pixels > F.lit(limits["pixels"]),
        "levels": F.col("levels") > limits["levels"],
        "array_elements": F.col("elements") > limits["array_elements"],
        "metadata": F.col("metadata_bytes") > limits["metadata"],
    }
    return F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())))


def largest_that_fits(candidates: DataFrame, group: list[str], quality: str, size: str, target: int) -> DataFrame:
    """The highest quality of each group whose size is within the target; null where even the lowest is not."""
    fits = F.when(F.col(size) <= target, F.col(quality))
    return candidates.groupBy(*group).agg(F.max(fits).alias(quality))
