"""Queries over the test tables, one or more per operator, and the SQL that says the same.

The tables hold no images, so their numbers stand in: lineitem rows are pixels with channels r, g, b, a;
each embedding is an 8 x 8 raster; texts are byte streams; events are measurements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imagelake.functions import grid, packed, predict, samples, video
from imagelake.operators import blocks, channels, dct, geometry, palette, stats
from imagelake.query_base import ORACLES, PIXELS, QUERIES, RASTER, byte_raster, pixels, query, raster, read

# ---------------------------------------------------------------- K: kernels

_U8 = "CAST(round_even(least(greatest(CAST({0} AS FLOAT) * CAST(255 AS FLOAT), 0), 255), 0) AS INT)"
_F8 = "(CAST({0} AS FLOAT) * CAST(0.003921568859368563 AS FLOAT))"


@query(f"WITH {PIXELS} SELECT id, n, r, {_U8.format(_F8.format('r'))} AS r2, CAST({_F8.format('r')} AS DOUBLE) AS f FROM px")
def unorm8_roundtrip(spark, sf_dir):
    f = samples.unorm_to_float(F.col("r"))
    return pixels(spark, sf_dir).select("id", "n", "r", samples.float_to_unorm(f).alias("r2"), f.cast("double").alias("f"))


@query("""WITH t AS (SELECT l_orderkey, CAST(round(l_extendedprice) AS BIGINT) % 65536 AS v FROM lineitem)
SELECT l_orderkey, v, CAST(round_even(least(greatest(CAST(CAST(v AS FLOAT) * CAST(1.5259021893143654e-05 AS FLOAT) AS FLOAT) * CAST(65535 AS FLOAT), 0), 65535), 0) AS INT) AS v2 FROM t""")
def unorm16_roundtrip(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.round("l_extendedprice").cast("long") % 65536).alias("v"))
    return t.withColumn("v2", samples.float_to_unorm(samples.unorm_to_float(F.col("v"), 16), 16))


_HALVES = "w AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST((l_orderkey * 40503 + l_partkey) % 65536 AS INT) AS w FROM lineitem)"


def _halves(spark, sf_dir):
    """lineitem's keys as words of half floats, but for infinities and what isn't a number."""
    w = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), ((F.col("l_orderkey") * 40503 + F.col("l_partkey")) % 65536).cast("int").alias("w"))
    return w.filter(F.shiftright("w", 10).bitwiseAND(31) < 31)


@query(f"""WITH {_HALVES}, p AS (SELECT *, CASE WHEN w & 32768 <> 0 THEN -1.0 ELSE 1.0 END AS s, (w >> 10) & 31 AS e, w & 1023 AS m FROM w)
SELECT k, n, w, CASE WHEN e = 0 THEN s * m * pow(2.0, -24) ELSE s * (1 + m / 1024.0) * pow(2.0, e - 15) END AS v, w & 32767 <> 0 OR w = 0 AS plain
FROM p WHERE e < 31""")
def half_decode(spark, sf_dir):
    return _halves(spark, sf_dir).select("k", "n", "w", samples.half_to_float(F.col("w")).alias("v"), ((F.col("w").bitwiseAND(32767) != 0) | (F.col("w") == 0)).alias("plain"))


@query(f"WITH {_HALVES} SELECT k, n, w, w AS w2 FROM w WHERE (w >> 10) & 31 < 31 AND w <> 32768")
def half_roundtrip(spark, sf_dir):
    return _halves(spark, sf_dir).filter("w != 32768").select("k", "n", "w", samples.float_to_half(samples.half_to_float(F.col("w"))).alias("w2"))


@query("SELECT l_orderkey, l_partkey, ((l_partkey & 255) << 24) | ((l_partkey >> 8 & 255) << 16) | ((l_partkey >> 16 & 255) << 8) | (l_partkey >> 24 & 255) AS swapped FROM lineitem")
def byte_order_swap(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", samples.byteswap(F.col("l_partkey"), 32).alias("swapped"))


@query(f"WITH {PIXELS} SELECT id, n, round(r / 255e0 * (a / 255e0), 9) AS pr, round(g / 255e0 * (a / 255e0), 9) AS pg FROM px")
def premultiply_alpha(spark, sf_dir):
    a = F.col("a") / 255
    return pixels(spark, sf_dir).select("id", "n", *(F.round(samples.premultiply(F.col(c) / 255, a), 9).alias(f"p{c}") for c in "rg"))


@query(f"WITH {PIXELS} SELECT id, n, CASE WHEN b = 0 THEN 0e0 ELSE round(r / CAST(b AS DOUBLE), 9) END AS ur FROM px")
def unpremultiply_alpha(spark, sf_dir):
    return pixels(spark, sf_dir).select("id", "n", F.round(samples.unpremultiply(F.col("r").cast("double"), F.col("b")), 9).alias("ur"))


@query(f"""WITH {PIXELS}, t AS (SELECT id, n, r / 255e0 - 0.2e0 AS v FROM px)
SELECT id, n, round(sign(v) * CASE WHEN abs(v) <= 0.0031308e0 THEN 12.92e0 * abs(v) ELSE 1.055e0 * pow(abs(v), 1 / 2.4e0) - 0.055e0 END, 9) + 0e0 AS s FROM t""")
def linear_to_srgb(spark, sf_dir):
    return pixels(spark, sf_dir).select("id", "n", (F.round(samples.linear_to_srgb(F.col("r") / 255 - 0.2), 9) + 0.0).alias("s"))


@query(f"""WITH {PIXELS}, t AS (SELECT id, n, r / 255e0 - 0.2e0 AS v FROM px)
SELECT id, n, round(sign(v) * CASE WHEN abs(v) <= 0.04045e0 THEN abs(v) / 12.92e0 ELSE pow((abs(v) + 0.055e0) / 1.055e0, 2.4e0) END, 9) + 0e0 AS s FROM t""")
def srgb_to_linear(spark, sf_dir):
    return pixels(spark, sf_dir).select("id", "n", (F.round(samples.srgb_to_linear(F.col("r") / 255 - 0.2), 9) + 0.0).alias("s"))


_Q = "CAST(floor(least(greatest({0} / 255e0, 0e0), 1e0) * {1} + 0.5e0) AS BIGINT)"


def _unit(t: DataFrame) -> dict[str, Column]:
    return {c: F.col(c) / 255 for c in "rgba"}


@query(f"""WITH {PIXELS} SELECT id, n, {_Q.format('r', 1023)} + ({_Q.format('g', 1023)} << 10) + ({_Q.format('b', 1023)} << 20) + ({_Q.format('a', 3)} << 30) AS rgb10a2,
{_Q.format('b', 31)} + ({_Q.format('g', 63)} << 5) + ({_Q.format('r', 31)} << 11) AS b5g6r5,
{_Q.format('b', 31)} + ({_Q.format('g', 31)} << 5) + ({_Q.format('r', 31)} << 10) + ({_Q.format('a', 1)} << 15) AS b5g5r5a1 FROM px""")
def pack_pixels(spark, sf_dir):
    t = pixels(spark, sf_dir)
    u = _unit(t)
    return t.select("id", "n", packed.pack_unorm(u, "r10g10b10a2").alias("rgb10a2"), packed.pack_unorm(u, "b5g6r5").alias("b5g6r5"), packed.pack_unorm(u, "b5g5r5a1").alias("b5g5r5a1"))


@query("""SELECT l_partkey, round((l_partkey & 31) / 31e0, 9) AS b, round((l_partkey >> 5 & 63) / 63e0, 9) AS g, round((l_partkey >> 11 & 31) / 31e0, 9) AS r FROM lineitem""")
def unpack_565(spark, sf_dir):
    u = packed.unpack_unorm(F.col("l_partkey"), "b5g6r5")
    return read(spark, sf_dir, "lineitem").select("l_partkey", *(F.round(u[c], 9).alias(c) for c in "bgr"))


@query(f"""WITH {PIXELS}, e AS (SELECT *, CASE WHEN r = 0 THEN 0e0 ELSE r * pow(2e0, g - 136) END AS rv FROM px) SELECT id, n, round(rv * 1e9, 4) AS rv FROM e""")
def rgbe_decode(spark, sf_dir):
    e = F.when(F.col("r") == 0, 0).otherwise(F.col("g"))
    return pixels(spark, sf_dir).select("id", "n", F.round(packed.rgbe_decode(F.col("r"), e) * 1e9, 4).alias("rv"))


@query(f"""WITH {PIXELS}, t AS (SELECT id, n, r / 16e0 AS r, g / 16e0 AS g, b / 16e0 AS b, greatest(r, g, b) / 16e0 AS m FROM px),
e AS (SELECT *, CASE WHEN m < 1e-32 THEN 0 ELSE (SELECT max(k) FROM range(-8, 8) k(k) WHERE pow(2e0, k) <= m) + 1 END AS e FROM t)
SELECT id, n, CASE WHEN m < 1e-32 THEN 0 ELSE CAST(floor(r * pow(2e0, 8 - e)) AS INT) END AS er,
CASE WHEN m < 1e-32 THEN 0 ELSE CAST(floor(g * pow(2e0, 8 - e)) AS INT) END AS eg,
CASE WHEN m < 1e-32 THEN 0 ELSE CAST(floor(b * pow(2e0, 8 - e)) AS INT) END AS eb, CASE WHEN m < 1e-32 THEN 0 ELSE CAST(e + 128 AS INT) END AS ee FROM e""")
def rgbe_encode(spark, sf_dir):
    t = packed.rgbe_encode(*(F.col(c) / 16 for c in "rgb"))
    return pixels(spark, sf_dir).select("id", "n", *(v.alias(f"e{k}") for k, v in t.items()))


@query(f"""WITH {PIXELS}, t AS (SELECT id, n, r * 3e0 AS r, g * 3e0 AS g, b * 3e0 AS b, greatest(r, g, b) * 3e0 AS m FROM px),
p AS (SELECT *, greatest(CASE WHEN m > 0 THEN (SELECT max(k) FROM range(-8, 12) k(k) WHERE pow(2e0, k) <= m) ELSE -16 END, -16) + 16 AS e0 FROM t),
e AS (SELECT *, CASE WHEN floor(m / pow(2e0, e0 - 24) + 0.5e0) = 512 THEN e0 + 1 ELSE e0 END AS e FROM p)
SELECT id, n, CAST(floor(r / pow(2e0, e - 24) + 0.5e0) AS BIGINT) + (CAST(floor(g / pow(2e0, e - 24) + 0.5e0) AS BIGINT) << 9)
+ (CAST(floor(b / pow(2e0, e - 24) + 0.5e0) AS BIGINT) << 18) + (CAST(e AS BIGINT) << 27) AS word FROM e""")
def rgb9e5_encode(spark, sf_dir):
    return pixels(spark, sf_dir).select("id", "n", packed.rgb9e5_encode(*(F.col(c) * 3.0 for c in "rgb")).alias("word"))


@query("""SELECT l_partkey, round((l_partkey & 511) * pow(2e0, (l_partkey >> 9 & 31) - 24), 12) AS v FROM lineitem""")
def rgb9e5_decode(spark, sf_dir):
    word = F.col("l_partkey").bitwiseAND(511) + F.shiftleft(F.shiftright("l_partkey", 9).bitwiseAND(31), 27)
    return read(spark, sf_dir, "lineitem").select("l_partkey", F.round(packed.rgb9e5_decode(word)["r"], 12).alias("v"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey * 7 % 1984 AS INT) AS w, CAST(l_partkey * 7 % 1984 AS BIGINT) AS w6, CAST(l_partkey * 5 % 992 AS BIGINT) AS w5 FROM lineitem")
def small_float_roundtrip(spark, sf_dir):
    """Words of floats with six and five bits of mantissa, decoded and encoded again."""
    w, five = (F.col("l_partkey") * 7 % 1984).cast("int"), (F.col("l_partkey") * 5 % 992).cast("int")
    back = lambda c, bits: packed.small_float_encode(packed.small_float_decode(c, bits), bits)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), w.alias("w"), back(w, 6).alias("w6"), back(five, 5).alias("w5"))


# ---------------------------------------------------------------- P: plan operators on pixels


@query(f"WITH {RASTER} SELECT vec_id, y - 2 AS y, x - 1 AS x, v FROM rs WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 6")
def crop_window(spark, sf_dir):
    return geometry.crop(raster(spark, sf_dir), 1, 2, 4, 5)


def _orientation(name: str):
    swap, sx, sy = geometry.ORIENTATIONS[name]
    a, b = ("y", "x") if swap else ("x", "y")
    nx, ny = (a if sx == 1 else f"7 - {a}"), (b if sy == 1 else f"7 - {b}")

    def run(spark, sf_dir):
        return geometry.orient(raster(spark, sf_dir), 8, 8, name).select("vec_id", "y", "x", "v")

    run.__name__ = f"orient_{name}"
    query(f"WITH {RASTER} SELECT vec_id, {ny} AS y, {nx} AS x, v FROM rs")(run)


for _name in geometry.ORIENTATIONS:
    _orientation(_name)


@query(f"""WITH {RASTER}, d AS (SELECT CAST(i AS INT) AS d, (i + 0.5e0) * 2 - 0.5e0 AS c FROM range(4) t(i)),
t AS (SELECT d, s.s, greatest(0e0, 1 - abs(s.s - c) / 2e0) AS w FROM d, (SELECT CAST(i AS INT) AS s FROM range(8) t(i)) s WHERE s.s >= floor(c - 2) AND s.s <= ceil(c + 2)),
k AS (SELECT d, s, w / sum(w) OVER (PARTITION BY d) AS w FROM t),
h AS (SELECT vec_id, y, d AS x, sum(v * w) AS v FROM rs JOIN k ON k.s = rs.x GROUP BY ALL)
SELECT vec_id, d AS y, x, round(sum(v * w), 6) + 0e0 AS v FROM h JOIN k ON k.s = h.y GROUP BY vec_id, d, x""")
def resample_tent(spark, sf_dir):
    out = geometry.resample(raster(spark, sf_dir), "vec_id", (8, 8), (4, 4), ["v"])
    return out.select("vec_id", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@query(f"""WITH {RASTER} SELECT vec_id, CAST(l AS INT) AS level, CAST(y >> l AS INT) AS y, CAST(x >> l AS INT) AS x, round(avg(v), 6) + 0e0 AS v FROM rs, range(4) t(l) GROUP BY vec_id, l, y >> l, x >> l""")
def mip_chain(spark, sf_dir):
    out = geometry.mip_chain(raster(spark, sf_dir), "vec_id", 8, ["v"])
    return out.select("vec_id", "level", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {PIXELS} SELECT id, n, g AS y, g AS red, g AS green, g AS blue, 255 AS alpha FROM px")
def gray_to_rgb_with_alpha(spark, sf_dir):
    out = channels.expand_grey(pixels(spark, sf_dir).select("id", "n", F.col("g").alias("y")), "y", None, ("red", "green", "blue"))
    return out.withColumnRenamed("A", "alpha")


@query("""SELECT l_orderkey, l_linenumber, s_nationkey AS idx, n_name, n_regionkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def palette_expand(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("idx"))
    indexed = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(s, "l_suppkey").drop("l_suppkey")
    colours = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), "n_name", "n_regionkey")
    return palette.expand(indexed, colours, []).select("l_orderkey", "l_linenumber", "idx", "n_name", "n_regionkey")


@query(f"WITH {PIXELS}, c AS (SELECT DISTINCT n, r, g FROM px), f AS (SELECT n FROM c GROUP BY n HAVING count(*) <= 600) SELECT n, r, g, row_number() OVER (PARTITION BY n ORDER BY r, g) - 1 AS idx FROM c WHERE n IN (SELECT n FROM f)")
def palette_build(spark, sf_dir):
    return palette.build(pixels(spark, sf_dir), ["n"], ["r", "g"], 600).withColumn("idx", F.col("idx").cast("long"))


@query(f"WITH {PIXELS} SELECT id, n, (least(r // 64, 3) * 4 + least(g // 64, 3)) * 4 + least(b // 64, 3) AS idx FROM px")
def palette_quantise(spark, sf_dir):
    return palette.quantise(pixels(spark, sf_dir), ["id"], ["r", "g", "b"]).select("id", "n", "idx")


@query("""SELECT vec_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(embedding[CAST((i // 8 - i // 8 % 2) * 8 + i % 8 - i % 2 AS INT) + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)""")
def subsample_replicate(spark, sf_dir):
    """Every second row and column is kept, and stands for its cell."""
    kept = raster(spark, sf_dir).filter(grid.on_grid(F.col("x"), 0, 2) & grid.on_grid(F.col("y"), 0, 2))
    return grid.replicate(kept, 2, 2, 8, 8).select("vec_id", "y", "x", "v")


@query("""SELECT vec_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) AS v,
CAST(embedding[CAST((i // 8 - i // 8 % 4) * 8 + i % 8 - i % 2 AS INT) + 1] AS DOUBLE) AS coarse FROM embeddings, range(64) t(i)""")
def subsample_fill(spark, sf_dir):
    """A channel on a grid of steps 2 and 4 beside one on every pixel."""
    on = grid.on_grid(F.col("x"), 0, 2) & grid.on_grid(F.col("y"), 0, 4)
    return grid.fill(raster(spark, sf_dir).withColumn("coarse", F.when(on, F.col("v"))), "vec_id", ["coarse"], 2, 4)


@query(f"WITH {RASTER} SELECT vec_id, y, x, c AS channel, CASE c WHEN 'p' THEN v ELSE -v END AS value FROM rs, (VALUES ('p'), ('q')) t(c)")
def deinterleave(spark, sf_dir):
    wide = raster(spark, sf_dir).select("vec_id", "y", "x", F.col("v").alias("p"), (-F.col("v")).alias("q"))
    return channels.deinterleave(wide, ["vec_id", "y", "x"], ["p", "q"])


@query(f"WITH {RASTER} SELECT vec_id, y, x, v AS p, -v AS q, CAST(NULL AS DOUBLE) AS r FROM rs")
def interleave(spark, sf_dir):
    return channels.interleave(deinterleave(spark, sf_dir), ["vec_id", "y", "x"], ["p", "q", "r"])


@query("""SELECT p_partkey, (p_size + 3) // 4 * ((p_partkey % 97 + 4) // 4) * 8 AS bc1_bytes, p_size * (p_partkey % 97 + 1) * 4 AS rgba_bytes,
(SELECT count(*) FROM range(-4, 200) t(i) WHERE i >= p_size - 30 AND i < p_partkey % 97 AND (i + 300) % 3 = 1) AS thirds FROM part""")
def encoded_byte_counts(spark, sf_dir):
    w, h, one = F.col("p_size").cast("long"), F.col("p_partkey") % 97 + 1, F.lit(1)
    t = read(spark, sf_dir, "part").select(
        "p_partkey", grid.encoded_bytes(w, h, one, 4, 4, 1, 64).cast("long").alias("bc1_bytes"), grid.encoded_bytes(w, h, one, 1, 1, 1, 32).cast("long").alias("rgba_bytes"),
        F.greatest(grid.samples_in(F.greatest(w - 30, F.lit(-4)), F.col("p_partkey") % 97, 1, 3), F.lit(0)).alias("thirds"),
    )
    return t


@query("""WITH p AS (SELECT p_partkey, p_size * 37 AS w, p_partkey % 500 + 1 AS h FROM part)
SELECT p_partkey, CAST(l AS INT) AS level, greatest(1, w >> l) AS width, greatest(1, h >> l) AS height FROM p, range(12) t(l) WHERE l <= floor(log2(greatest(w, h)))""")
def mip_levels(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).cast("long").alias("w"), (F.col("p_partkey") % 500 + 1).alias("h"))
    levels = p.withColumn("level", F.explode(F.sequence(F.lit(0), grid.level_count(F.greatest("w", "h")) - 1)))
    return levels.select("p_partkey", "level", grid.level_size(F.col("w"), F.col("level")).alias("width"), grid.level_size(F.col("h"), F.col("level")).alias("height"))


@query("""WITH p AS (SELECT p_partkey, p_size * 37 AS w FROM part)
SELECT p_partkey, CAST(x AS INT) AS lx, CAST(y AS INT) AS ly, greatest(1, w >> x) AS width, greatest(1, 64 >> y) AS height FROM p, range(12) a(x), range(7) b(y) WHERE x <= floor(log2(w))""")
def rip_levels(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).cast("long").alias("w"))
    p = p.withColumn("lx", F.explode(F.sequence(F.lit(0), grid.level_count(F.col("w")) - 1))).withColumn("ly", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return p.select("p_partkey", "lx", "ly", grid.level_size(F.col("w"), F.col("lx")).alias("width"), grid.level_size(F.lit(64), F.col("ly")).alias("height"))


@query("""WITH p AS (SELECT p_partkey, p_size * 37 AS w, p_partkey % 300 + 1 AS h FROM part)
SELECT p_partkey, count(*) AS tiles, CAST(sum(least(64, w - tx * 64) * least(64, h - ty * 64)) AS BIGINT) AS area FROM p, range(40) a(tx), range(8) b(ty) WHERE tx * 64 < w AND ty * 64 < h GROUP BY p_partkey""")
def tile_grid(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).cast("long").alias("w"), (F.col("p_partkey") % 300 + 1).alias("h"))
    t = p.withColumn("tx", F.explode(F.sequence(F.lit(0), grid.ceil_div(F.col("w"), 64) - 1))).withColumn("ty", F.explode(F.sequence(F.lit(0), grid.ceil_div(F.col("h"), 64) - 1)))
    area = F.least(F.lit(64), F.col("w") - F.col("tx") * 64) * F.least(F.lit(64), F.col("h") - F.col("ty") * 64)
    return t.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("tiles"), F.sum(area).cast("long").alias("area"))


# ---------------------------------------------------------------- E, G: prediction


@query(f"WITH {RASTER} SELECT vec_id, y, x, CASE WHEN x = 0 THEN v ELSE ((v - lag(v) OVER w + 128) % 256 + 256) % 256 END AS d FROM br WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)")
def byte_predictor(spark, sf_dir):
    w = Window.partitionBy("vec_id", "y").orderBy("x")
    return byte_raster(spark, sf_dir).select("vec_id", "y", "x", predict.byte_delta(F.col("v"), F.lag("v").over(w)).alias("d"))


@query(f"WITH {RASTER} SELECT vec_id, y, x, v FROM br")
def byte_predictor_inverse(spark, sf_dir):
    w = Window.partitionBy("vec_id", "y").orderBy("x")
    return byte_predictor(spark, sf_dir).select("vec_id", "y", "x", predict.byte_undelta(F.col("d"), w).cast("int").alias("v"))


@query(f"WITH {RASTER} SELECT vec_id, y, x, v, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 4 + x // 2 END AS at FROM br")
def byte_split(spark, sf_dir):
    return byte_raster(spark, sf_dir).select("vec_id", "y", "x", "v", predict.split_position(F.col("x"), F.lit(8)).cast("int").alias("at"))


_NEAR = f"""{RASTER}, nb AS (SELECT vec_id, y, x, v, coalesce(lag(v) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS l, coalesce(lag(v) OVER (PARTITION BY vec_id, x ORDER BY y), 0) AS u FROM br),
nc AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY vec_id, y ORDER BY x), 0) AS c FROM nb),
ps AS (SELECT *, abs(u - c) AS dl, abs(l - c) AS du, abs(l + u - 2 * c) AS dc FROM nc),
fl AS (SELECT vec_id, y, x, v % 256 AS f0, ((v - l) % 256 + 256) % 256 AS f1, ((v - u) % 256 + 256) % 256 AS f2, ((v - (l + u) // 2) % 256 + 256) % 256 AS f3,
((v - CASE WHEN dl <= du AND dl <= dc THEN l WHEN du <= dc THEN u ELSE c END) % 256 + 256) % 256 AS f4 FROM ps)"""


@query(f"WITH {_NEAR} SELECT vec_id, y, x, f0 AS f_none, f1 AS f_sub, f2 AS f_up, f3 AS f_average, f4 AS f_paeth FROM fl")
def png_filters(spark, sf_dir):
    near = predict.with_neighbours(byte_raster(spark, sf_dir), "vec_id")
    made = predict.filtered(F.col("v"), F.col("left"), F.col("up"), F.col("corner"))
    return near.select("vec_id", "y", "x", *(c.alias(f"f_{k}") for k, c in made.items()))


@query(f"""WITH {_NEAR}, s AS (SELECT vec_id, y, unnest([sum(least(f0, 256 - f0)), sum(least(f1, 256 - f1)), sum(least(f2, 256 - f2)), sum(least(f3, 256 - f3)), sum(least(f4, 256 - f4))]) AS score, generate_subscripts([1, 2, 3, 4, 5], 1) - 1 AS filter_id FROM fl GROUP BY vec_id, y)
SELECT vec_id, y, CAST(filter_id AS INT) AS filter_id, CAST(score AS BIGINT) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id, y ORDER BY score, filter_id) = 1""")
def png_filter_select(spark, sf_dir):
    return predict.best_filter(byte_raster(spark, sf_dir), "vec_id")


@query(f"""WITH {_NEAR}, e AS (SELECT vec_id, y, unnest([f0, f1, f2, f3, f4]) AS b, generate_subscripts([0, 1, 2, 3, 4], 1) AS k FROM fl), c AS (SELECT vec_id, y, k, b, count(*) AS n FROM e GROUP BY ALL),
h AS (SELECT vec_id, y, k, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY vec_id, y, k), m AS (SELECT vec_id, y, min(h) AS h FROM h GROUP BY vec_id, y)
SELECT vec_id, round(avg(h), 6) + 0e0 AS entropy, round(avg(h), 6) >= 2.5e0 AS stored FROM m GROUP BY vec_id""")
def png_least_entropy(spark, sf_dir):
    """Whether an image is better stored than packed; rows of eight bytes have three bits at most."""
    out = predict.least_entropy(byte_raster(spark, sf_dir), "vec_id")
    entropy = F.round("entropy", 6) + 0.0
    return out.select("vec_id", entropy.alias("entropy"), (entropy >= 2.5).alias("stored"))


@query(f"WITH {RASTER} SELECT vec_id, y, x, v FROM br")
def png_unfilter_sub_up(spark, sf_dir):
    near = predict.with_neighbours(byte_raster(spark, sf_dir), "vec_id")
    f = predict.filtered(F.col("v"), F.col("left"), F.col("up"), F.col("corner"))
    t = near.select("vec_id", "y", "x", f["sub"].alias("s"), f["up"].alias("u"))
    along = Window.partitionBy("vec_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("vec_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    both = t.select("vec_id", "y", "x", F.pmod(F.sum("s").over(along), F.lit(256)).alias("v"), F.pmod(F.sum("u").over(down), F.lit(256)).alias("w"))
    return both.filter("v = w").select("vec_id", "y", "x", F.col("v").cast("int").alias("v"))


@query(f"""WITH {RASTER} SELECT vec_id, CASE WHEN x % 8 = 0 AND y % 8 = 0 THEN 1 WHEN x % 8 = 4 AND y % 8 = 0 THEN 2 WHEN x % 4 = 0 AND y % 8 = 4 THEN 3 WHEN x % 4 = 2 AND y % 4 = 0 THEN 4
WHEN x % 2 = 0 AND y % 4 = 2 THEN 5 WHEN x % 2 = 1 AND y % 2 = 0 THEN 6 ELSE 7 END AS pass, count(*) AS samples, CAST(sum(v) AS BIGINT) AS total FROM br GROUP BY ALL""")
def adam7_histogram(spark, sf_dir):
    t = byte_raster(spark, sf_dir).withColumn("pass", predict.adam7_pass(F.col("x"), F.col("y")))
    return t.groupBy("vec_id", "pass").agg(F.count(F.lit(1)).alias("samples"), F.sum("v").alias("total"))


@query(f"""WITH {RASTER}, q AS (SELECT vec_id, y * 8 + x AS i, v // 64 AS v FROM br), f AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS n FROM q WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
g AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY i) AS r FROM f) SELECT vec_id, v, min(i) AS start, count(*) AS length FROM g GROUP BY vec_id, r, v""")
def run_lengths(spark, sf_dir):
    t = byte_raster(spark, sf_dir).select("vec_id", (F.col("y") * 8 + F.col("x")).alias("i"), F.floor(F.col("v") / 64).cast("int").alias("v"))
    return predict.runs(t, "vec_id", "i", "v").select("vec_id", "v", "start", "length")


@query(f"WITH {RASTER}, d AS (SELECT DISTINCT v FROM br) SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM d")
def piz_lookup(spark, sf_dir):
    values = byte_raster(spark, sf_dir).select("v").distinct()  # at most 65,536 values of 16 bits
    return values.select("v", (F.dense_rank().over(Window.orderBy("v")) - 1).cast("long").alias("code"))


@query(f"WITH {PIXELS} SELECT id, n, ((r - g) % 256 + 256) % 256 AS sr, ((b - g) % 256 + 256) % 256 AS sb, r AS r2, b AS b2 FROM px")
def subtract_green(spark, sf_dir):
    t = pixels(spark, sf_dir)
    sr, sb = predict.subtract_green(F.col("r"), F.col("g"), F.col("b"))
    r2, b2 = predict.add_green(sr, F.col("g"), sb)
    return t.select("id", "n", sr.alias("sr"), sb.alias("sb"), r2.alias("r2"), b2.alias("b2"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS digest FROM documents")
def text_digests(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


@query("""WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
s AS (SELECT p_partkey, p_partkey || ':' || p_size AS s FROM part)
SELECT p_partkey, xor(list_reduce([4294967295] || list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM s, tab""")
def crc32_check_value(spark, sf_dir):
    """Checksums of the parts' keys and sizes, against the table of the polynomial."""
    return read(spark, sf_dir, "part").select("p_partkey", F.crc32(F.concat_ws(":", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).cast("binary")).alias("crc"))


# ---------------------------------------------------------------- C, J: blocks and transforms


def _block_rows(spark, sf_dir):
    return blocks.to_blocks(byte_raster(spark, sf_dir), "vec_id")


@query(f"""WITH {RASTER}, e AS (SELECT vec_id, y // 4 AS brow, x // 4 AS bcol, y % 4 * 4 + x % 4 AS t, v, max(v) OVER w AS v0, min(v) OVER w AS v1 FROM br WINDOW w AS (PARTITION BY vec_id, y // 4, x // 4)),
p AS (SELECT *, CASE WHEN v0 > v1 THEN [v0, v1, (6*v0+v1)//7, (5*v0+2*v1)//7, (4*v0+3*v1)//7, (3*v0+4*v1)//7, (2*v0+5*v1)//7, (v0+6*v1)//7] ELSE [v0, v1, v0, v0, v0, v0, 0, 255] END AS pal FROM e),
c AS (SELECT vec_id, brow, bcol, t, v, v0, v1, unnest(pal) AS q, generate_subscripts(pal, 1) - 1 AS k FROM p),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id, brow, bcol, t ORDER BY abs(v - q), k) = 1)
SELECT vec_id, brow, bcol, v0, v1, CAST(sum(k) AS BIGINT) AS index_sum, CAST(sum(abs(v - q)) AS BIGINT) AS error FROM b GROUP BY ALL""")
def bc4_blocks(spark, sf_dir):
    t = blocks.bc4_decode(blocks.bc4_encode(_block_rows(spark, sf_dir)))
    error = F.aggregate(F.zip_with("texels", "decoded", lambda a, b: F.abs(a - b)), F.lit(0), lambda a, b: a + b)
    return t.select("vec_id", "brow", "bcol", "v0", "v1", F.aggregate("indices", F.lit(0), lambda a, b: a + b).cast("long").alias("index_sum"), error.cast("long").alias("error"))


@query(f"""WITH {RASTER}, t AS (SELECT vec_id, y // 4 AS brow, x // 4 AS bcol, y % 4 * 4 + x % 4 AS t, v AS r, (v * 7 + 3) % 256 AS g, 255 - v AS b FROM br),
p AS (SELECT a.vec_id, a.brow, a.bcol, a.t AS i, b.t AS j, (a.r-b.r)*(a.r-b.r)+(a.g-b.g)*(a.g-b.g)+(a.b-b.b)*(a.b-b.b) AS d, (a.r//8)*2048+(a.g//4)*32+a.b//8 AS pa, (b.r//8)*2048+(b.g//4)*32+b.b//8 AS pb
FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.brow = b.brow AND a.bcol = b.bcol)
SELECT vec_id, brow, bcol, d AS distance, greatest(pa, pb) AS color0, least(pa, pb) AS color1 FROM p QUALIFY row_number() OVER (PARTITION BY vec_id, brow, bcol ORDER BY d DESC, i, j) = 1""")
def bc1_endpoints(spark, sf_dir):
    t = _block_rows(spark, sf_dir).withColumns({
        "g": F.transform("texels", lambda v: (v * 7 + 3) % 256), "b": F.transform("texels", lambda v: 255 - v),
    })
    return blocks.bc1_endpoints(t, "texels", "g", "b").select("vec_id", "brow", "bcol", "distance", "color0", "color1")


@query(f"WITH {PIXELS} SELECT id, n, least(15, (a + 8) // 17) AS code, least(15, (a + 8) // 17) * 17 AS decoded FROM px")
def bc2_alpha(spark, sf_dir):
    code = blocks.bc2_alpha_encode(F.col("a"))
    return pixels(spark, sf_dir).select("id", "n", code.alias("code"), blocks.bc2_alpha_decode(code).alias("decoded"))


_DCT = f"""{RASTER}, bs AS (SELECT CAST(k AS INT) AS k, CAST(n AS INT) AS n, CASE WHEN k = 0 THEN sqrt(0.125e0) ELSE 0.5e0 END * cos((2 * n + 1) * k * pi() / 16e0) AS c FROM range(8) a(k), range(8) b(n)),
h AS (SELECT vec_id, y, k AS x, sum(v * c) AS v FROM rs JOIN bs ON bs.n = rs.x GROUP BY ALL), dc AS (SELECT vec_id, k AS y, x, sum(v * c) AS v FROM h JOIN bs ON bs.n = h.y GROUP BY vec_id, k, x)"""


@query(f"WITH {_DCT} SELECT vec_id, y, x, round(v, 6) + 0e0 AS v FROM dc")
def dct8x8_forward(spark, sf_dir):
    return dct.transform(raster(spark, sf_dir), "vec_id").select("vec_id", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@query(f"WITH {RASTER} SELECT vec_id, y, x, round(v, 6) + 0e0 AS v FROM rs")
def dct8x8_inverse(spark, sf_dir):
    out = dct.transform(dct.transform(raster(spark, sf_dir), "vec_id"), "vec_id", inverse=True)
    return out.select("vec_id", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@query(f"""WITH {_DCT}, qt AS (SELECT * FROM (VALUES {', '.join(f'({p // 8}, {p % 8}, {zz}, {dct.scaled_table(90)[p]})' for zz, p in enumerate(dct.zigzag()))}) t(qy, qx, zz, step))
SELECT vec_id, y, x, zz, CAST(round_even(round(v * 512, 6) / step, 0) AS INT) AS q FROM dc JOIN qt ON qy = y AND qx = x""")
def dct8x8_quantize(spark, sf_dir):
    coefficients = dct.transform(raster(spark, sf_dir), "vec_id").withColumn("v", F.round(F.col("v") * 512, 6))
    return dct.quantised(coefficients, 90).select("vec_id", "y", "x", "zz", "q")


@query(f"WITH {PIXELS} SELECT id, n, round(0.299e0*r+0.587e0*g+0.114e0*b-128, 6) AS y, round(-0.168736e0*r-0.331264e0*g+0.5e0*b, 6) + 0e0 AS cb, round(0.5e0*r-0.418688e0*g-0.081312e0*b, 6) + 0e0 AS cr FROM px")
def rgb_to_ycbcr(spark, sf_dir):
    y, cb, cr = dct.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, sf_dir).select("id", "n", F.round(y, 6).alias("y"), (F.round(cb, 6) + 0.0).alias("cb"), (F.round(cr, 6) + 0.0).alias("cr"))


# ---------------------------------------------------------------- M: figures and rankings


@query(f"""WITH {PIXELS} SELECT n, round(avg((r - g) * (r - g)), 6) AS mse, round(10 * log10(65025e0 / avg((r - g) * (r - g))), 6) AS psnr, max(abs(r - g)) + 0e0 AS max_error,
count(*) FILTER (WHERE r <> g) AS differing, round(avg(abs(r - g)), 6) AS mae, count(*) AS samples FROM px GROUP BY n""")
def psnr_report(spark, sf_dir):
    out = stats.error_report(pixels(spark, sf_dir), ["n"], "r", "g")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mse", "psnr", "mae")), "max_error", "differing", "samples")


@query("SELECT event_type, round(exp(avg(ln(value + 1))), 6) AS gmean FROM events GROUP BY event_type")
def geometric_means(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(stats.geometric_mean(F.col("value") + 1), 6).alias("gmean"))


@query("""WITH e AS (SELECT user_id, event_type FROM events), k AS (SELECT count(DISTINCT event_type) AS k FROM e) SELECT user_id FROM e GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT k FROM k)""")
def complete_groups(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type")
    return stats.complete_groups(e, ["user_id"], "event_type", e)


@query("""WITH p AS (SELECT p_partkey, p_size, p_partkey % 7 AS g, p_partkey % 101 AS cost FROM part)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.g = p.g AND q.p_size <= p.p_size AND q.cost <= p.cost AND (q.p_size < p.p_size OR q.cost < p.cost))""")
def pareto_frontier(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 7).alias("g"), (F.col("p_partkey") % 101).alias("cost"))
    return stats.pareto(p, "g", "p_size", "cost")


@query("SELECT p_partkey, p_size, rank() OVER (PARTITION BY p_partkey % 50 ORDER BY p_size) AS place FROM part")
def rank_with_ties(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("g", F.col("p_partkey") % 50)
    return p.select("p_partkey", "p_size", stats.rank_with_ties(p, ["g"], F.col("p_size")).cast("long").alias("place"))


@query(f"WITH {RASTER}, c AS (SELECT vec_id, v // 16 AS v, count(*) AS k FROM br GROUP BY ALL) SELECT vec_id, CAST(sum(k) AS BIGINT) AS n, count(*) AS distinct_values, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) + 0e0 AS entropy FROM c GROUP BY vec_id")
def byte_entropy(spark, sf_dir):
    t = byte_raster(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 16))
    return stats.entropy(t, ["vec_id"], "v").withColumn("entropy", F.round("entropy", 6) + 0.0)


@query("SELECT event_type, count(*) AS outcomes, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def outcome_counters(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("outcomes"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH c AS (SELECT p_partkey, q, p_size * 100 + q * (p_partkey % 37 + 1) AS bytes FROM part, range(0, 101) t(q)) SELECT p_partkey, max(q) FILTER (WHERE bytes <= 4000) AS q FROM c GROUP BY p_partkey""")
def target_size_search(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long"))).alias("q"))
    return stats.largest_that_fits(p.withColumn("bytes", F.col("p_size") * 100 + F.col("q") * (F.col("p_partkey") % 37 + 1)), ["p_partkey"], "q", "bytes", 4000)


@query(f"""WITH {PIXELS}, c AS (SELECT n, id, r * 10 + 100 AS size, g * 10 + 100 AS peer, b * 1e0 AS mse, b * 0.9e0 AS peer_mse, a % 2 = 0 AS lossless FROM px)
SELECT n, count(*) FILTER (WHERE size <= 1.2e0 * peer AND CASE WHEN lossless THEN mse = 0 AND peer_mse = 0 ELSE mse <= 1.25e0 * peer_mse + 2 END) AS passed FROM c GROUP BY n""")
def quality_gate(spark, sf_dir):
    t = pixels(spark, sf_dir)
    ok = stats.passes_quality(F.col("r") * 10 + 100, F.col("g") * 10 + 100, F.col("b") * 1.0, F.col("b") * 0.9, F.col("a") % 2 == 0)
    return t.groupBy("n").agg(F.count_if(ok).alias("passed"))


@query("""WITH a AS (SELECT p_partkey, p_size % 3 AS parts, p_size % 5 AS channels, p_size * 3000 AS width, p_partkey % 90000 AS height, p_size % 20 AS levels, p_partkey * 100 AS metadata_bytes, p_partkey % 11 AS elements FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN parts > 1 THEN 'parts' END, CASE WHEN channels > 3 THEN 'channels' END, CASE WHEN greatest(width, height) > 65536 THEN 'dimension' END,
CASE WHEN CAST(width AS HUGEINT) * height > 100000000 THEN 'pixels' END, CASE WHEN levels > 16 THEN 'levels' END, CASE WHEN elements > 6 THEN 'array_elements' END, CASE WHEN metadata_bytes > 150000 THEN 'metadata' END) AS violations FROM a""")
def limit_violations(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    a = read(spark, sf_dir, "part").select("p_partkey", (s % 3).alias("parts"), (s % 5).alias("channels"), (s * 3000).alias("width"), (k % 90000).alias("height"), (s % 20).alias("levels"), (k * 100).alias("metadata_bytes"), (k % 11).alias("elements"))
    limits = {"parts": 1, "channels": 3, "dimension": 65536, "pixels": 100_000_000, "levels": 16, "array_elements": 6, "metadata": 150_000}
    return a.select("p_partkey", F.array_join(stats.violations(a, limits), ",").alias("violations"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to float and back, with the error of each line number's image over all of its pixels."""
    t = pixels(spark, sf_dir)
    back = t.withColumn("r2", samples.float_to_unorm(samples.unorm_to_float(F.col("r"))))
    return stats.error_report(back, ["n"], "r", "r2")


# ---------------------------------------------------------------- S: codecs and catalogue


@query("""SELECT n_nationkey, CASE n_nationkey % 9 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'dds' WHEN 3 THEN 'hdr' WHEN 5 THEN 'exr' WHEN 6 THEN 'ktx2' WHEN 7 THEN 'webp' WHEN 8 THEN 'hdr' END AS format FROM nation""")
def format_probe(spark, sf_dir):
    from imagelake.sources import catalog

    heads = [
        "89504E470D0A1A0A0000", "FFD8FFE0", "444453207C000000", "233F52414449414E43450A", "00112233",
        "762F310102000000", "AB4B5458203230BB0D0A1A0A00", "524946460000000057454250", "233F524742450A",
    ]
    content = F.get(F.array(*map(F.lit, heads)), (F.col("n_nationkey") % 9).cast("int"))
    return read(spark, sf_dir, "nation").select("n_nationkey", catalog.probe(F.unhex(content)).alias("format"))


@query("""WITH p AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(255 * x // 10 AS INT) AS h, CAST(255 * y // 4 AS INT) AS v FROM (SELECT DISTINCT p_partkey % 55 // 11 AS y, p_partkey % 11 AS x FROM part)),
n AS (SELECT y, x, c, ((x * 73856093) ^ (y * 19349663) ^ ((c * 83492791) ^ 2654435769)) & 4294967295 AS k0 FROM p, range(3) t(c)),
n1 AS (SELECT y, x, c, CAST((CAST(xor(k0, k0 >> 16) AS HUGEINT) * 73244475) % 4294967296 AS BIGINT) AS k1 FROM n),
n2 AS (SELECT y, x, c, CAST((CAST(xor(k1, k1 >> 15) AS HUGEINT) * 739982445) % 4294967296 AS BIGINT) >> 24 AS k FROM n1),
w AS (SELECT y, x, CAST(max(k) FILTER (WHERE c = 0) AS INT) AS r, CAST(max(k) FILTER (WHERE c = 1) AS INT) AS g, CAST(max(k) FILTER (WHERE c = 2) AS INT) AS b FROM n2 GROUP BY y, x)
SELECT 'flat' AS pattern, y, x, 127 AS r, 127 AS g, 127 AS b, 255 AS a FROM p
UNION ALL SELECT 'ramp', y, x, h, v, (h + v) // 2, 255 FROM p
UNION ALL SELECT 'checker', y, x, xor(x, y) % 2 * 255, xor(x, y) % 2 * 255, xor(x, y) % 2 * 255, 255 FROM p
UNION ALL SELECT 'impulse', y, x, CASE WHEN x = 5 AND y = 2 THEN 255 ELSE 0 END, CASE WHEN x = 5 AND y = 2 THEN 255 ELSE 0 END, CASE WHEN x = 5 AND y = 2 THEN 255 ELSE 0 END, 255 FROM p
UNION ALL SELECT 'stripes', y, x, x % 2 * 255, y % 2 * 255, (x + y) % 2 * 255, 255 FROM p
UNION ALL SELECT 'chroma', y, x, CASE WHEN x // 8 % 2 = 0 THEN 255 ELSE 0 END, CASE WHEN x // 8 % 2 = 0 THEN 0 ELSE 128 END, CASE WHEN x // 8 % 2 = 0 THEN 0 ELSE 255 END, 255 FROM p
UNION ALL SELECT 'alpha', y, x, h, v, 255 - h, h FROM p
UNION ALL SELECT 'noise', y, x, r, g, b, 255 FROM w""".replace("((x * 73856093) ^ (y * 19349663) ^ ((c * 83492791) ^ 2654435769))", "xor(xor(x * 73856093::BIGINT, y * 19349663::BIGINT), xor(c * 83492791::BIGINT, 2654435769::BIGINT))"))
def test_images(spark, sf_dir):
    """Pixels of 11 x 5 images of every pattern, those that the parts' keys name."""
    from imagelake.operators import generate

    k, out = F.col("p_partkey"), None
    named = read(spark, sf_dir, "part").select(F.floor(k % 55 / 11).cast("long").alias("y"), (k % 11).cast("long").alias("x")).distinct()
    for name in generate.PATTERNS:
        one = named.join(generate.image(spark, name, 11, 5), ["y", "x"]).select(F.lit(name).alias("pattern"), F.col("y").cast("int"), F.col("x").cast("int"), "r", "g", "b", "a")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- more of J, W, G, E, R, F


@query(f"WITH {RASTER} SELECT vec_id, y // 2 AS y, x // 2 AS x, round(avg(v), 6) + 0e0 AS v FROM rs GROUP BY vec_id, y // 2, x // 2")
def chroma_average(spark, sf_dir):
    return geometry.halve(raster(spark, sf_dir), "vec_id", ["v"]).select("vec_id", "y", "x", (F.round("v", 6) + 0.0).alias("v"))


@query(f"""WITH {RASTER}, n AS (SELECT *, coalesce(lag(v) OVER w, v) AS l, coalesce(lead(v) OVER w, v) AS r FROM rs WINDOW w AS (PARTITION BY vec_id, y ORDER BY x))
SELECT vec_id, y, 2 * x + k AS x, round((3 * v + CASE k WHEN 0 THEN l ELSE r END) / 4, 6) + 0e0 AS v FROM n, (VALUES (0), (1)) t(k)""")
def chroma_upsample(spark, sf_dir):
    row = Window.partitionBy("vec_id", "y").orderBy("x")
    near = raster(spark, sf_dir).withColumns({"l": F.coalesce(F.lag("v").over(row), "v"), "r": F.coalesce(F.lead("v").over(row), "v")})
    both = near.select("vec_id", "y", "x", F.posexplode(F.array((3 * F.col("v") + F.col("l")) / 4, (3 * F.col("v") + F.col("r")) / 4)).alias("k", "u"))
    return both.select("vec_id", "y", (2 * F.col("x") + F.col("k")).alias("x"), (F.round("u", 6) + 0.0).alias("v"))


@query(f"""WITH {_DCT}, qt AS (SELECT * FROM (VALUES {', '.join(f'({p // 8}, {p % 8}, {zz}, {dct.scaled_table(90)[p]})' for zz, p in enumerate(dct.zigzag()))}) t(qy, qx, zz, step)),
q AS (SELECT vec_id, zz, CAST(round_even(round(v * 512, 6) / step, 0) AS INT) AS q FROM dc JOIN qt ON qy = y AND qx = x),
n AS (SELECT *, zz - coalesce(lag(zz) OVER (PARTITION BY vec_id ORDER BY zz), 0) - 1 AS run FROM q WHERE zz > 0 AND q <> 0)
SELECT vec_id, zz, run // 16 AS long_runs, run % 16 * 16 + length(bin(abs(q))) AS symbol FROM n""")
def ac_symbols(spark, sf_dir):
    """(zero run, size) tokens of quantised coefficients in zig-zag order: gaps between the nonzero ones."""
    coefficients = dct.transform(raster(spark, sf_dir), "vec_id").withColumn("v", F.round(F.col("v") * 512, 6))
    some = dct.quantised(coefficients, 90).filter("zz > 0 and q != 0")
    run = F.col("zz") - F.coalesce(F.lag("zz").over(Window.partitionBy("vec_id").orderBy("zz")), F.lit(0)) - 1
    return some.select("vec_id", "zz", run.alias("run"), "q").select(
        "vec_id", "zz", F.floor(F.col("run") / 16).cast("int").alias("long_runs"), (F.col("run") % 16 * 16 + F.length(F.bin(F.abs("q")))).cast("long").alias("symbol")
    )


@query(f"WITH {PIXELS} SELECT id, n, ((16839*r + 33059*g + 6420*b + 32768) >> 16) + 16 AS y, ((-9719*r*4 - 19081*g*4 + 28800*b*4 + 131072) >> 18) + 128 AS u, ((28800*r*4 - 24116*g*4 - 4684*b*4 + 131072) >> 18) + 128 AS v FROM px")
def rgb_to_yuv_fixed(spark, sf_dir):
    u, v = video.chroma(*(F.col(c) * 4 for c in "rgb"))
    return pixels(spark, sf_dir).select("id", "n", video.luma(F.col("r"), F.col("g"), F.col("b")).alias("y"), u.alias("u"), v.alias("v"))


@query("SELECT p_partkey, CAST(q AS INT) AS quality, CAST((127 * (100 - q) + 50) // 100 AS INT) AS quantiser, CAST(least(255, greatest(1, (p_size * CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END + 50) // 100)) AS INT) AS step FROM (SELECT p_partkey, p_size, p_partkey % 100 + 1 AS q FROM part)")
def quality_steps(spark, sf_dir):
    q = F.col("quality")
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 100 + 1).cast("int").alias("quality")).select("p_partkey", "quality", video.quantiser(q).alias("quantiser"), video.jpeg_step(F.col("p_size"), q).alias("step"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 500 AS units, p_size * 5000 AS nonzero FROM part), s AS (SELECT *, least(units // 4, 16, greatest(1, nonzero // 8192)) AS n FROM p)
SELECT p_partkey, CAST(CASE WHEN units <= 4 OR n <= 1 THEN 0 ELSE (units + n - 1) // n END AS INT) AS every FROM s""")
def restart_intervals(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", video.restart_interval(F.col("p_partkey") % 500, F.col("p_size").cast("long") * 5000, 16).alias("every"))


@query(f"WITH {_NEAR} SELECT vec_id, y, x, ((v - CASE WHEN x = 0 AND y = 0 THEN 0 WHEN x = 0 THEN u WHEN y = 0 THEN l ELSE least(greatest(l + u - c, 0), 255) END) % 256 + 256) % 256 AS residual FROM ps")
def alpha_gradient_filter(spark, sf_dir):
    near = predict.with_neighbours(byte_raster(spark, sf_dir), "vec_id")
    left, up, corner = (F.coalesce(F.col(c), F.lit(0)) for c in ("left", "up", "corner"))
    p = F.when(F.col("x") == 0, up).when(F.col("y") == 0, left).otherwise(video.gradient(left, up, corner))
    return near.select("vec_id", "y", "x", F.pmod(F.col("v") - p, F.lit(256)).alias("residual"))


@query("""WITH r AS (SELECT p_partkey, CAST(y AS INT) AS y, p_size * 2 + CASE WHEN y % 2 = 0 THEN (p_size + 1) // 2 * 4 ELSE 0 END AS bytes FROM part, range(8) t(y))
SELECT p_partkey, y, CAST(coalesce(sum(bytes) OVER (PARTITION BY p_partkey ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM r""")
def block_row_offsets(spark, sf_dir):
    """Byte offsets of rows where a channel stands in every second row only: a running sum."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
    size = F.col("p_size") * 2 + F.when(grid.on_grid(F.col("y"), 0, 2), grid.ceil_div(F.col("p_size"), 2) * 4).otherwise(0)
    return grid.row_offsets(rows.withColumn("bytes", size), "p_partkey", "y", "bytes").select("p_partkey", "y", "at")


@query("""SELECT p_partkey, CAST(c AS INT) AS channel, ((p_partkey % 7) * 50 + p_size) * 3 * 2 + c * 2 AS interleaved, (c * 9 + p_partkey % 7) * 50 * 2 + p_size * 2 AS planar FROM part, range(3) t(c)""")
def sample_offsets(spark, sf_dir):
    """Byte offsets of 16-bit samples of three channels in rows of 50, interleaved and in planes of 9 rows."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("x"), (F.col("p_partkey") % 7).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel"))
    x, y, c = F.col("x"), F.col("y"), F.col("channel")
    return p.select("p_partkey", "channel", grid.sample_at(x, y, c, 50, 3, 2).alias("interleaved"), grid.sample_at(x, y, c, 50, 3, 2, 9).alias("planar"))


@query("SELECT l_orderkey, l_partkey & 255 AS byte, CAST(i AS INT) AS i, (l_partkey & 255) >> CAST(6 - 2 * i AS INT) & 3 AS sample FROM lineitem, range(4) t(i)")
def bit_unpack(spark, sf_dir):
    """2-bit samples of a byte, highest bits first."""
    b = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").bitwiseAND(255).alias("byte"))
    return b.select("l_orderkey", "byte", F.posexplode(grid.unpack_bits(F.col("byte"), 2)).alias("i", "sample"))


@query("SELECT l_orderkey, l_partkey & 255 AS byte, CAST(b AS INT) AS bits, l_partkey & 255 AS packed FROM lineitem, (VALUES (1), (2), (4), (8)) t(b)")
def bit_pack_roundtrip(spark, sf_dir):
    """Bytes to samples of 1, 2, 4 and 8 bits and back."""
    b = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").bitwiseAND(255).alias("byte"))
    each = F.array(*(F.struct(F.lit(n).alias("bits"), grid.pack_bits(grid.unpack_bits(F.col("byte"), n), n).cast("long").alias("packed")) for n in (1, 2, 4, 8)))
    return b.select("l_orderkey", "byte", F.inline(each))


@query(f"WITH {RASTER} SELECT vec_id, y - 5 AS y, x + 10 AS x, v FROM rs")
def map_window(spark, sf_dir):
    return geometry.map_window(raster(spark, sf_dir), 10, -5)


@query("""WITH p AS (SELECT p_partkey, p_size AS w, p_partkey % 40 + 1 AS h, p_partkey % 3 + 1 AS n, CASE WHEN p_partkey % 5 = 0 THEN 6 ELSE 1 END AS f FROM part)
SELECT p_partkey, CAST(e AS INT) AS element, CAST(a AS INT) AS face, CAST(l AS INT) AS level, (greatest(1, w >> l) + 3) // 4 * ((greatest(1, h >> l) + 3) // 4) * 8 AS bytes
FROM p, range(3) x(e), range(6) y(a), range(7) z(l) WHERE e < n AND a < f AND l <= floor(log2(greatest(w, h)))""")
def subresource_bytes(spark, sf_dir):
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("w"), (k % 40 + 1).alias("h"), (k % 3).cast("int").alias("n"), F.when(k % 5 == 0, 5).otherwise(0).alias("f"))
    p = p.withColumn("element", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("face", F.explode(F.sequence(F.lit(0), F.col("f"))))
    p = p.withColumn("level", F.explode(F.sequence(F.lit(0), grid.level_count(F.greatest("w", "h")) - 1)))
    w, h = (grid.level_size(F.col(c), F.col("level")) for c in "wh")
    return p.select("p_partkey", "element", "face", "level", grid.encoded_bytes(w, h, F.lit(1), 4, 4, 1, 64).cast("long").alias("bytes"))


@query("""SELECT n_nationkey, CASE n_nationkey % 10 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'dds' WHEN 3 THEN 'hdr' WHEN 4 THEN 'exr' WHEN 5 THEN 'ktx2' WHEN 6 THEN 'webp' WHEN 7 THEN 'hdr'
WHEN 8 THEN CASE n_nationkey // 10 WHEN 0 THEN 'webp' WHEN 1 THEN 'jpeg' END END AS format FROM nation""")
def registry_resolve(spark, sf_dir):
    """The format of a file by its first bytes, which count more than its extension; without them by its extension."""
    from imagelake.sources import catalog

    heads = ["89504E470D0A1A0A0000", "FFD8FFE0", "444453207C000000", "233F52414449414E43450A", "762F310102000000", "AB4B5458203230BB0D0A1A0A00", "524946460000000057454250", "233F52474245", "00112233", "FF"]
    names = ["jpg", ".JPEG", "", "png", "exr", "dds", "gif", "pic", None, "txt"]
    at = (F.col("n_nationkey") % 10).cast("int")
    name = F.when(at == 8, F.get(F.array(F.lit(".WEBP"), F.lit("jpg"), F.lit("bmp")), F.floor(F.col("n_nationkey") / 10).cast("int"))).otherwise(F.get(F.array(*map(F.lit, names)), at))
    return read(spark, sf_dir, "nation").select("n_nationkey", catalog.resolved(F.unhex(F.get(F.array(*map(F.lit, heads)), at)), name).alias("format"))


@query("""WITH p AS (SELECT p_partkey, list_filter(['A', 'Z', 'G', 'R', 'Y', 'B'], lambda c, i: (p_partkey >> (i - 1)) & 1 = 1) AS c FROM part)
SELECT p_partkey, array_to_string(list_filter(CASE WHEN len(list_filter(c, lambda x: x NOT IN ('Y', 'A'))) = 0 THEN ['Y', 'A'] ELSE ['R', 'G', 'B', 'A', 'Y'] END, lambda x: list_contains(c, x))[1:4], '') AS channels FROM p""")
def channel_canonical_order(spark, sf_dir):
    letters = F.array(*map(F.lit, "AZGRYB"))
    p = read(spark, sf_dir, "part").select("p_partkey", F.filter(letters, lambda c, i: F.getbit("p_partkey", i) == 1).alias("c"))
    return p.select("p_partkey", F.array_join(channels.canonical(F.col("c"), 4), "").alias("channels"))


@query("SELECT p_partkey, p_size AS width, p_partkey % 3 AS faces, 'unorm8' AS sample FROM part WHERE p_partkey % 7 <> 3")
def descriptor_json_roundtrip(spark, sf_dir):
    """Versioned descriptors to JSON and back; other versions are rejected."""
    from imagelake.sources import descriptor

    version = F.when(F.col("p_partkey") % 7 == 3, "imagelake.descriptor/0").otherwise(descriptor.VERSION)
    part = F.struct(F.col("p_partkey").alias("id"), F.col("p_size").alias("width"), (F.col("p_partkey") % 3).alias("faces"), F.lit("unorm8").alias("sample"))
    back = descriptor.from_document(descriptor.to_document(part, version), "id long, width int, faces long, sample string")
    return read(spark, sf_dir, "part").select(back.alias("d")).filter("d is not null").select(F.col("d.id").alias("p_partkey"), "d.width", "d.faces", "d.sample")


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_partkey % 13 AS g, p_size * 1e0 AS v FROM part), m AS (SELECT DISTINCT g, v FROM p),
b AS (SELECT g, 1 AS band, min(v) AS low FROM m GROUP BY g UNION ALL SELECT b.g, b.band + 1, (SELECT min(m.v) FROM m WHERE m.g = b.g AND m.v > b.low * (1 + 0.05e0)) FROM b
  WHERE EXISTS (SELECT 1 FROM m WHERE m.g = b.g AND m.v > b.low * (1 + 0.05e0)))
SELECT p.p_partkey, (SELECT max(b.band) FROM b WHERE b.g = p.g AND b.low <= p.v) AS band FROM p""")
def tolerance_bands(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 13).alias("g"), (F.col("p_size") * 1.0).alias("v"))
    return stats.banded(p, "g", "v", 0.05).select("p_partkey", "band")


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_partkey % 13 AS g, p_size * 1e0 AS v, p_partkey * 37 % 101 * 1e0 AS w FROM part), m AS (SELECT DISTINCT g, v FROM p),
b AS (SELECT g, 1 AS band, min(v) AS low FROM m GROUP BY g UNION ALL SELECT b.g, b.band + 1, (SELECT min(m.v) FROM m WHERE m.g = b.g AND m.v > b.low * (1 + 0.05e0)) FROM b
  WHERE EXISTS (SELECT 1 FROM m WHERE m.g = b.g AND m.v > b.low * (1 + 0.05e0))),
x AS (SELECT p.*, (SELECT max(b.band) FROM b WHERE b.g = p.g AND b.low <= p.v) AS band FROM p)
SELECT p_partkey, band, row_number() OVER (PARTITION BY g ORDER BY band, w, v, p_partkey) AS place FROM x""")
def tradeoff_order(spark, sf_dir):
    """Bands of near sizes, the best time first within a band."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").select("p_partkey", (k % 13).alias("g"), (F.col("p_size") * 1.0).alias("v"), (k * 37 % 101 * 1.0).alias("w"))
    return stats.tradeoff_order(p, "g", "v", "w", 0.05, ["p_partkey"]).select("p_partkey", "band", F.col("place").cast("long").alias("place"))


@query("""WITH m AS (SELECT n_nationkey, list_filter([{'ns': 'text', 'size': n_nationkey * 10 + 1}, {'ns': 'icc', 'size': n_nationkey * 7}, {'ns': 'text', 'size': 55}], lambda e, i: n_nationkey % 4 <> i) AS es FROM nation)
SELECT n_nationkey, CAST(list_sum(list_transform(es, lambda e: e.size)) AS BIGINT) AS total, list_max(list_transform(es, lambda e: e.size)) AS largest,
len(list_filter(es, lambda e: e.ns = 'text')) > 0 AS any_text, len(list_filter(es, lambda e: e.ns <> 'text')) = 0 AS all_text,
array_to_string(list_sort(list_distinct(list_transform(es, lambda e: e.ns))), ',') AS names, array_to_string(list_sort(list_distinct(list_transform(list_filter(es, lambda e: e.ns <> 'text'), lambda e: e.ns))), ',') AS other_names,
array_to_string(list_reverse_sort(list_transform(es, lambda e: e.size))[1:2], ',') AS top_two FROM m""")
def metadata_figures(spark, sf_dir):
    k = F.col("n_nationkey")
    entry = lambda ns, size: F.struct(F.lit(ns).alias("ns"), size.cast("long").alias("size"))
    entries = F.array(entry("text", k * 10 + 1), entry("icc", k * 7), entry("text", F.lit(55)))
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.filter(entries, lambda e, i: k % 4 != i + 1).alias("es"))
    return n.select("n_nationkey", *(c.alias(name) for name, c in stats.metadata_report(F.col("es")).items()))


from imagelake import queries_blocks, queries_codecs, queries_files, queries_plans  # noqa: E402, F401  they add theirs to the same registry
