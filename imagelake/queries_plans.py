"""Queries that go through planner and lowering, and the planner's rules as tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imagelake.plans.frame import ImageFrame
from imagelake.plans.planner import Capabilities, Description, PlanError, plan
from imagelake.query_base import PIXELS, RASTER, byte_raster, pixels, query, raster, read
from imagelake.sources.catalog import REGISTRY

CODECS = REGISTRY.codecs
_FRAME = f"{RASTER}, fr AS (SELECT vec_id AS image, y, x, v AS L, v AS R, (v * 7 + 3) % 256 AS G, 255 - v AS B, 255 - (v * 3) % 256 AS A FROM br)"
_UNIT = "(CAST({0} AS FLOAT) * CAST(0.003921568859368563 AS FLOAT))"


def frame(spark: SparkSession, sf_dir: str, **what) -> ImageFrame:
    """The embeddings as 8 x 8 images of eight bits with channels L (for Y), R, G, B, A."""
    v = F.col("v")
    px = byte_raster(spark, sf_dir).select(F.col("vec_id").alias("image"), "y", "x", v.alias("L"), v.alias("R"), ((v * 7 + 3) % 256).alias("G"), (255 - v).alias("B"), (255 - v * 3 % 256).alias("A"))
    return ImageFrame(px, Description(8, 8, **{"channels": ("R", "G", "B")} | what))


@query(f"WITH {_FRAME} SELECT image, y, x, R, G, B FROM fr")
def plan_select_part(spark, sf_dir):
    """The first of two parts, for a codec that holds one."""
    f = frame(spark, sf_dir, parts=2)
    both = f.data.withColumn("part", F.lit(0)).unionByName(f.data.withColumns({"part": F.lit(1), "R": F.lit(7)}))
    return ImageFrame(both, f.description).pixels(CODECS["png"], "preview")


@query(f"WITH {_FRAME} SELECT image, y, x, R, G, B FROM fr")
def plan_select_channels(spark, sf_dir):
    """Channels in canonical order, without those that the codec doesn't know."""
    f = frame(spark, sf_dir, channels=("A", "Z", "G", "B", "R"))
    return ImageFrame(f.data.withColumn("Z", F.lit(1)), f.description).pixels(CODECS["jpeg"], "preview")


@query(f"WITH {_FRAME} SELECT image, y, x, L AS R, L AS G, L AS B FROM fr")
def plan_grey_expansion(spark, sf_dir):
    return frame(spark, sf_dir, channels=("Y",)).pixels(CODECS["webp"])


@query(f"WITH {_FRAME} SELECT image, y, x, R, G, B, 255 AS A FROM fr")
def plan_opaque_alpha(spark, sf_dir):
    return frame(spark, sf_dir).pixels(CODECS["dds"])


@query(f"WITH {_FRAME} SELECT image, y, x, L * 3 % 256 AS R, 255 - L AS G, L // 2 AS B FROM fr")
def plan_palette(spark, sf_dir):
    f = frame(spark, sf_dir)
    palette = spark.range(256).select(F.col("id").cast("int").alias("I")).select("I", (F.col("I") * 3 % 256).alias("R"), (255 - F.col("I")).alias("G"), F.floor(F.col("I") / 2).cast("int").alias("B"))
    return ImageFrame(f.data.select("image", "y", "x", F.col("L").alias("I")), Description(8, 8, ("I",), indexed=True), palette=palette).pixels(CODECS["png"])


@query(f"WITH {RASTER} SELECT vec_id AS image, y, x, CAST(round_even(least(greatest(CAST(abs(v) AS FLOAT) * CAST(65535 AS FLOAT), 0), 65535), 0) AS INT) AS L FROM rs")
def plan_sample_type(spark, sf_dir):
    """Floats for a codec of integers become 16-bit ones."""
    px = raster(spark, sf_dir).select(F.col("vec_id").alias("image"), "y", "x", F.abs("v").alias("L"))
    return ImageFrame(px, Description(8, 8, ("Y",), "float32")).pixels(CODECS["png"], "preview")


@query("""SELECT vec_id AS image, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, CAST(least(greatest(floor(CAST(embedding[CAST((i // 8 - i // 8 % 2) * 8 + i % 8 - i % 2 AS INT) + 1] AS DOUBLE) * 256) + 128, 0), 255) AS INT) AS L FROM embeddings, range(64) t(i)""")
def plan_subsampled(spark, sf_dir):
    """Images stored on every second row and column only."""
    f = frame(spark, sf_dir, channels=("Y",), subsampled=(2, 2))
    return ImageFrame(f.data.filter("x % 2 = 0 and y % 2 = 0"), f.description).pixels(CODECS["png"])


_COARSE = "CAST(least(greatest(floor(CAST(embedding[CAST((i // 8 - i // 8 % 2) * 8 + i % 8 - i % 2 AS INT) + 1] AS DOUBLE) * 256) + 128, 0), 255) AS INT)"
_FINE = "CAST(least(greatest(floor(CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) * 256) + 128, 0), 255) AS INT)"


@query(f"WITH v AS (SELECT vec_id AS image, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, {_FINE} AS v, {_COARSE} AS c FROM embeddings, range(64) t(i)) SELECT image, y, x, v AS R, (v * 7 + 3) % 256 AS G, 255 - c AS B FROM v")
def plan_subsampled_channel(spark, sf_dir):
    """One channel of three on a coarser grid."""
    f = frame(spark, sf_dir, subsampled=("B",))
    return ImageFrame(f.data.withColumn("B", F.when((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0), F.col("B"))), f.description).pixels(CODECS["png"])


@query(f"WITH {_FRAME} SELECT image, y - 2 AS y, 5 - x AS x, R, G, B FROM fr WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 7")
def plan_crop_and_orient(spark, sf_dir):
    """A crop of 5 x 6 at (1, 2), then flipped: x becomes 4 - (x - 1)."""
    return frame(spark, sf_dir, orientation="flip_x").crop(1, 2, 5, 6).pixels(CODECS["png"], "preview")


@query(f"WITH {_FRAME} SELECT image, 0 AS y, 0 AS x, CAST(round_even(avg(R), 0) AS INT) AS L FROM fr GROUP BY image")
def plan_resample(spark, sf_dir):
    """Flat images to one pixel: whatever the filter, the value stays."""
    f = frame(spark, sf_dir, channels=("Y",))
    mean = f.data.groupBy("image").agg(F.rint(F.avg("R")).cast("int").alias("m"))
    flat = f.data.join(mean, "image").select("image", "y", "x", F.col("m").alias("L"))
    return ImageFrame(flat, f.description).resize(1, 1).pixels(CODECS["png"], "preview").select("image", F.col("y").cast("int"), F.col("x").cast("int"), "L")


@query(f"WITH {_FRAME} SELECT image, y - 5 AS y, x + 10 AS x, R, G, B FROM fr")
def plan_map_window(spark, sf_dir):
    f = frame(spark, sf_dir)
    return f.run(f.plan(CODECS["png"]).then("map_window", 10, -5))


def _rounded(df: DataFrame, names: str) -> DataFrame:
    return df.select("image", "y", "x", *((F.round(c, 6) + 0.0).alias(c) for c in names))


_FLOAT = "CAST({0} AS DOUBLE)"


@query(f"""WITH {_FRAME}, u AS (SELECT image, y, x, {', '.join(_FLOAT.format(_UNIT.format(c)) + f' AS {c}' for c in 'RGBA')} FROM fr)
SELECT image, y, x, round(R * A, 6) + 0e0 AS R, round(G * A, 6) + 0e0 AS G, round(B * A, 6) + 0e0 AS B, round(A, 6) + 0e0 AS A FROM u""")
def plan_premultiply(spark, sf_dir):
    f = frame(spark, sf_dir, channels=("R", "G", "B", "A"))
    return _rounded(f.run(f.plan(CODECS["exr"], "preview").then("premultiply")), "RGBA")


@query(f"""WITH {_FRAME}, u AS (SELECT image, y, x, {', '.join(_FLOAT.format(_UNIT.format(c)) + f' AS {c}' for c in 'RGBA')} FROM fr)
SELECT image, y, x, CASE WHEN A = 0 THEN 0e0 ELSE round(R / A, 6) + 0e0 END AS R, CASE WHEN A = 0 THEN 0e0 ELSE round(G / A, 6) + 0e0 END AS G, CASE WHEN A = 0 THEN 0e0 ELSE round(B / A, 6) + 0e0 END AS B, round(A, 6) + 0e0 AS A FROM u""")
def plan_unpremultiply(spark, sf_dir):
    return _rounded(frame(spark, sf_dir, channels=("R", "G", "B", "A"), premultiplied=True).pixels(CODECS["exr"], "preview"), "RGBA")


@query(f"""WITH {_FRAME}, u AS (SELECT image, y, x, {', '.join(_FLOAT.format(_UNIT.format(c)) + f' AS {c}' for c in 'RGBA')} FROM fr)
SELECT image, y, x, {', '.join(f"round(CASE WHEN {c} <= 0.0031308e0 THEN 12.92e0 * {c} ELSE 1.055e0 * pow({c}, 1 / 2.4e0) - 0.055e0 END, 6) + 0e0 AS {c}" for c in 'RGB')}, round(A, 6) + 0e0 AS A FROM u""")
def plan_color_transform(spark, sf_dir):
    """Colours change, alpha doesn't."""
    f = frame(spark, sf_dir, channels=("R", "G", "B", "A"))
    return _rounded(f.run(f.plan(CODECS["exr"], "preview").then("color_transform", "linear", "srgb")), "RGBA")


# ---------------------------------------------------------------- elements

_Q = "CAST(floor(CAST({0} AS DOUBLE) * {1} + 0.5e0) AS BIGINT)"


def _packed(fields: str) -> str:
    """SQL of a word: channel:bits@place ..."""
    parts = []
    for f in fields.split():
        c, n, at = f[0], int(f[1:].split("@")[0]), int(f.split("@")[1])
        parts.append(f"({_Q.format(_UNIT.format(c), (1 << n) - 1)} << {at})")
    return " + ".join(parts)


def _encode(encoding: str, fields: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir, channels=("R", "G", "B", "A")).pixels(CODECS["dds"], "preview", encoding)

    run.__name__ = f"plan_encode_{encoding}"
    query(f"WITH {_FRAME} SELECT image, y, x, {_packed(fields)} AS element FROM fr")(run)


for _name, _fields in (("b5g6r5", "B5@0 G6@5 R5@11"), ("b5g5r5a1", "B5@0 G5@5 R5@10 A1@15"), ("r10g10b10a2", "R10@0 G10@10 B10@20 A2@30")):
    _encode(_name, _fields)


@query(f"""WITH {_FRAME}, u AS (SELECT image, y, x, {', '.join(_FLOAT.format(_UNIT.format(c)) + f' AS {c}' for c in 'RGB')} FROM fr), m AS (SELECT *, greatest(R, G, B) AS t FROM u),
e AS (SELECT *, (SELECT max(k) FROM range(-12, 2) k(k) WHERE pow(2e0, k) <= t) + 1 AS e FROM m)
SELECT image, y, x, CAST(floor(R * pow(2e0, 8 - e)) AS BIGINT) + (CAST(floor(G * pow(2e0, 8 - e)) AS BIGINT) << 8) + (CAST(floor(B * pow(2e0, 8 - e)) AS BIGINT) << 16) + (CAST(e + 128 AS BIGINT) << 24) AS element FROM e""")
def plan_encode_rgbe(spark, sf_dir):
    """A codec that has shared exponents gets them without being asked."""
    return frame(spark, sf_dir).pixels(CODECS["hdr"], "preview")


def _decode(encoding: str, sql: str, word: Callable[[], Column], channels: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.lit(0).alias("y"), F.lit(0).alias("x"), word().alias("element"))
        out = ImageFrame(one, Description(1, 1, tuple(channels), "float32", encoding=encoding)).pixels(CODECS["exr"], "preview")
        return _rounded(out, channels)

    run.__name__ = f"plan_decode_{encoding}"
    query(sql)(run)


_decode(
    "b5g6r5", "SELECT p_partkey AS image, 0 AS y, 0 AS x, round((p_partkey >> 11 & 31) / 31e0, 6) + 0e0 AS R, round((p_partkey >> 5 & 63) / 63e0, 6) + 0e0 AS G, round((p_partkey & 31) / 31e0, 6) + 0e0 AS B FROM part",
    lambda: F.col("p_partkey") % 65536, "RGB",
)
_decode(
    "rgb9e5", "SELECT p_partkey AS image, 0 AS y, 0 AS x, round((p_partkey & 511) * pow(2e0, p_size % 32 - 24), 6) + 0e0 AS R, round((p_size & 511) * pow(2e0, p_size % 32 - 24), 6) + 0e0 AS G, round(7 * pow(2e0, p_size % 32 - 24), 6) + 0e0 AS B FROM part",
    lambda: F.col("p_partkey").bitwiseAND(511) + F.shiftleft(F.col("p_size").bitwiseAND(511).cast("long"), 9) + F.lit(7 << 18) + F.shiftleft((F.col("p_size") % 32).cast("long"), 27), "RGB",
)
_decode(
    "rgbe", "SELECT p_partkey AS image, 0 AS y, 0 AS x, round((p_partkey & 255) * pow(2e0, p_size % 20 + 120 - 136), 6) + 0e0 AS R, round((p_size & 255) * pow(2e0, p_size % 20 + 120 - 136), 6) + 0e0 AS G, round(9 * pow(2e0, p_size % 20 + 120 - 136), 6) + 0e0 AS B FROM part",
    lambda: F.col("p_partkey").bitwiseAND(255) + F.shiftleft(F.col("p_size").bitwiseAND(255).cast("long"), 8) + F.lit(9 << 16) + F.shiftleft((F.col("p_size") % 20 + 120).cast("long"), 24), "RGB",
)
_S6 = "CASE WHEN {0} >> {1} = 0 THEN ({0} & {2}) / {3}e0 * pow(2e0, -14) ELSE (1 + ({0} & {2}) / {3}e0) * pow(2e0, ({0} >> {1}) - 15) END"
_decode(
    "r11g11b10f", f"SELECT p_partkey AS image, 0 AS y, 0 AS x, round({_S6.format('(p_partkey % 1984)', 6, 63, 64)}, 6) + 0e0 AS R, round({_S6.format('(p_size * 30)', 6, 63, 64)}, 6) + 0e0 AS G, round({_S6.format('(p_partkey % 992)', 5, 31, 32)}, 6) + 0e0 AS B FROM part",
    lambda: F.col("p_partkey") % 1984 + F.shiftleft((F.col("p_size") * 30).cast("long"), 11) + F.shiftleft(F.col("p_partkey") % 992, 22), "RGB",
)


@query("SELECT p_partkey AS image, CAST(b AS INT) AS brow, 0 AS bcol, md5(p_partkey || ':' || b) AS element FROM part, range(2) t(b)")
def plan_transcode(spark, sf_dir):
    """Blocks that the target holds as well pass through as they are, whatever their bytes."""
    b = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("brow"))
    b = b.withColumns({"bcol": F.lit(0), "element": F.unhex(F.md5(F.concat_ws(":", F.col("image").cast("string"), F.col("brow").cast("string"))))})
    out = ImageFrame(b, Description(4, 8, ("R", "G", "B", "A"), encoding="bc7")).pixels(CODECS["ktx2"], "strict")
    return out.withColumn("element", F.lower(F.hex("element")))


@query(f"""WITH {_FRAME}, e AS (SELECT image, y, x, R, max(R) OVER w AS v0, min(R) OVER w AS v1 FROM fr WINDOW w AS (PARTITION BY image, y // 4, x // 4)),
p AS (SELECT *, CASE WHEN v0 > v1 THEN [v0, v1, (6*v0+v1)//7, (5*v0+2*v1)//7, (4*v0+3*v1)//7, (3*v0+4*v1)//7, (2*v0+5*v1)//7, (v0+6*v1)//7] ELSE [v0, v1, v0, v0, v0, v0, 0, 255] END AS pal FROM e),
q AS (SELECT image, y, x, R, unnest(pal) AS q, generate_subscripts(pal, 1) - 1 AS k FROM p)
SELECT image, y, x, round(CAST({_UNIT.format('q')} AS DOUBLE), 6) + 0e0 AS R FROM q QUALIFY row_number() OVER (PARTITION BY image, y, x ORDER BY abs(R - q), k) = 1""")
def plan_block_round_trip(spark, sf_dir):
    """To blocks by one plan, and from blocks to floats by another."""
    f = frame(spark, sf_dir, channels=("R",))
    coded = f.pixels(CODECS["dds"], "preview", "bc4")
    out = ImageFrame(coded, Description(8, 8, ("R",), encoding="bc4")).pixels(CODECS["exr"], "preview")
    return _rounded(out, "R")


# ---------------------------------------------------------------- rules as tables


def _values(rows: list[tuple], names: str) -> str:
    """SQL: each part with one of some rows, by its key."""
    quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    listed = ", ".join(f"({k}, " + ", ".join(map(quoted, r)) + ")" for k, r in enumerate(rows))
    return f"SELECT p_partkey, {names} FROM part JOIN (VALUES {listed}) t(k, {names}) ON k = p_partkey % {len(rows)}"


def _planned(spark: SparkSession, sf_dir: str, cases: int, made: Callable[[int], tuple], names: str) -> DataFrame:
    """Each part with what the planner makes, in tasks, of the case that its key names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            columns = list(zip(*(made(k % cases) for k in keys), strict=True)) or [()] * len(names.split(","))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in columns)], ["p_partkey", *(n.strip() for n in names.split(","))])

    ddl = ", ".join(f"{n.strip()} string" for n in names.split(","))
    return read(spark, sf_dir, "part").select("p_partkey").mapInArrow(run, f"p_partkey long, {ddl}")


def outcome(source: Description, target, policy: str = "preview", **what) -> tuple[str, str, str, str, str]:
    """(steps, channels, sample, encoding, losses) of a plan, or the reason why there is none."""
    try:
        p = plan(source, target if isinstance(target, Capabilities) else Capabilities.of(CODECS[target]), policy, **what)
    except PlanError:
        return "none", "", "", "", ""
    t = p.target
    losses = ",".join(sorted({x.category + ("" if x.semantic else "*") for x in p.losses}))
    return " ".join(s.name for s in p.steps), "".join(t.channels), t.sample, t.encoding or "", f"{t.width}x{t.height} {losses}"


RGB, RGBA = ("R", "G", "B"), ("R", "G", "B", "A")
#: (case, source, target, what is asked for, and what the rules give: steps, channels, sample, encoding, extent and losses;
#: losses with a star keep the meaning).
CASES = (
    ("same", Description(8, 6, RGB), "png", {}, ("", "RGB", "unorm8", "", "8x6 ")),
    ("whole crop", Description(8, 6, RGB), "png", {"crop": (0, 0, 8, 6), "resize": (8, 6)}, ("", "RGB", "unorm8", "", "8x6 ")),
    ("crop", Description(8, 6, RGB), "png", {"crop": (1, 1, 4, 5)}, ("crop", "RGB", "unorm8", "", "4x5 topology*")),
    ("resize", Description(8, 6, RGB), "png", {"resize": (4, 3)}, ("resample", "RGB", "unorm8", "", "4x3 topology*")),
    ("both", Description(8, 6, RGB), "png", {"crop": (2, 2, 4, 4), "resize": (2, 2)}, ("crop resample", "RGB", "unorm8", "", "2x2 topology*")),
    ("rotated", Description(8, 6, RGB, orientation="rotate90"), "png", {}, ("orient", "RGB", "unorm8", "", "6x8 orientation*")),
    ("rotated and kept", Description(8, 6, RGB, "float32", orientation="rotate90"), "hdr", {}, ("encode_elements", "RGB", "float32", "rgbe", "8x6 compression")),
    ("no width", Description(8, 6, RGB), "png", {"resize": (0, 3)}, ("none", "", "", "", "")),
    ("crop outside", Description(8, 6, RGB), "png", {"crop": (5, 0, 4, 1)}, ("none", "", "", "", "")),
    ("negative crop", Description(8, 6, RGB), "png", {"crop": (-1, 0, 4, 1)}, ("none", "", "", "", "")),
    ("unknown encoding", Description(8, 6, RGB), "png", {"encoding": "bc1"}, ("none", "", "", "", "")),
    ("no encoder", Description(8, 6, RGBA), "dds", {"encoding": "bc7"}, ("none", "", "", "", "")),
    ("grey and wide", Description(8, 6, ("Y",)), "webp", {}, ("map_channels", "RGB", "unorm8", "", "8x6 ")),
    ("grey alpha and wide", Description(8, 6, ("Y", "A")), "webp", {}, ("map_channels", "RGBA", "unorm8", "", "8x6 ")),
    ("grey kept", Description(8, 6, ("Y",)), "jpeg", {}, ("", "Y", "unorm8", "", "8x6 ")),
    ("padded", Description(8, 6, RGB), "dds", {}, ("synthesize select_channels", "RGBA", "unorm8", "", "8x6 ")),
    ("unordered", Description(8, 6, ("B", "R", "A", "G")), "png", {}, ("select_channels", "RGBA", "unorm8", "", "8x6 ")),
    ("dropped", Description(8, 6, ("R", "G", "B", "Z")), "png", {}, ("select_channels", "RGB", "unorm8", "", "8x6 channel")),
    ("only unknown", Description(8, 6, ("Z",)), "png", {}, ("none", "", "", "", "")),
    ("any names", Description(8, 6, ("Z", "diffuse.R"), "float32"), "exr", {}, ("", "Zdiffuse.R", "float32", "", "8x6 ")),
    ("float to 16 bits", Description(8, 6, RGB, "float16"), "png", {}, ("convert_sample", "RGB", "unorm16", "", "8x6 dynamic_range")),
    ("float to 8 bits", Description(8, 6, RGB, "float32"), "jpeg", {}, ("convert_sample", "RGB", "unorm8", "", "8x6 dynamic_range")),
    ("16 to 8 bits", Description(8, 6, RGB, "unorm16"), "webp", {}, ("convert_sample", "RGB", "unorm8", "", "8x6 numeric")),
    ("8 bits to float", Description(8, 6, RGB, "unorm8"), "exr", {}, ("convert_sample", "RGB", "float32", "", "8x6 numeric")),
    ("words", Description(8, 6, RGB, "uint32"), "png", {}, ("none", "", "", "", "")),
    ("parts", Description(8, 6, RGB, parts=3), "png", {}, ("select_part", "RGB", "unorm8", "", "8x6 topology")),
    ("parts kept", Description(8, 6, RGB, "float16", parts=3), "exr", {}, ("", "RGB", "float16", "", "8x6 ")),
    ("subsampled", Description(8, 6, RGB, subsampled=("B",)), "png", {}, ("change_grid", "RGB", "unorm8", "", "8x6 sampling*")),
    ("premultiplied", Description(8, 6, RGBA, premultiplied=True), "png", {}, ("unpremultiply", "RGBA", "unorm8", "", "8x6 ")),
    ("metadata", Description(8, 6, RGB, metadata=("b", "a", "b")), "png", {}, ("drop_metadata drop_metadata", "RGB", "unorm8", "", "8x6 metadata")),
    ("indexed", Description(8, 6, ("I",), indexed=True), "png", {}, ("expand_indexed", "RGB", "unorm8", "", "8x6 ")),
    ("indexed with odd palette", Description(8, 6, ("I",), indexed=True, palette_bits=4), "png", {}, ("none", "", "", "", "")),
    ("same blocks", Description(8, 6, RGBA, encoding="bc3"), "dds", {}, ("transcode", "RGBA", "unorm8", "bc3", "8x6 ")),
    ("other blocks", Description(8, 6, RGBA, encoding="bc3"), "dds", {"encoding": "bc1"}, ("decode_elements encode_elements", "RGBA", "unorm8", "bc1", "8x6 compression")),
    ("cropped blocks", Description(8, 6, RGBA, encoding="bc3"), "dds", {"crop": (0, 0, 4, 4)}, ("decode_elements crop", "RGBA", "unorm8", "", "4x4 topology*")),
    ("blocks to files", Description(8, 6, RGBA, encoding="bc7"), "png", {}, ("decode_elements", "RGBA", "unorm8", "", "8x6 ")),
    ("one channel of blocks", Description(8, 6, RGB), "dds", {"encoding": "bc4"}, ("select_channels encode_elements", "R", "unorm8", "bc4", "8x6 channel,compression")),
    ("grey in blocks", Description(8, 6, ("Y",)), "dds", {"encoding": "bc4"}, ("map_channels select_channels encode_elements", "R", "unorm8", "bc4", "8x6 compression")),
    ("two channels of blocks", Description(8, 6, RGB), "dds", {"encoding": "bc5"}, ("select_channels encode_elements", "RG", "unorm8", "bc5", "8x6 channel,compression")),
    ("blocks with alpha", Description(8, 6, RGB), "dds", {"encoding": "bc3"}, ("synthesize select_channels encode_elements", "RGBA", "unorm8", "bc3", "8x6 compression")),
    ("packed", Description(8, 6, RGBA), "dds", {"encoding": "b5g6r5"}, ("select_channels encode_elements", "RGB", "unorm8", "b5g6r5", "8x6 channel,compression")),
    ("packed with 16 bits", Description(8, 6, RGBA), "dds", {"encoding": "r10g10b10a2"}, ("convert_sample encode_elements", "RGBA", "unorm16", "r10g10b10a2", "8x6 compression,numeric")),
    ("packed halves", Description(8, 6, RGB, "float32"), "dds", {"encoding": "rgb9e5"}, ("convert_sample encode_elements", "RGB", "float16", "rgb9e5", "8x6 compression,numeric")),
    ("two channels for three", Description(8, 6, ("R", "G")), "webp", {}, ("synthesize select_channels", "RGA", "unorm8", "", "8x6 ")),
    ("two channels for one or three", Description(8, 6, ("Y", "A")), "jpeg", {}, ("map_channels select_channels", "RGB", "unorm8", "", "8x6 channel")),
    ("no count fits", Description(8, 6, ("R",)), Capabilities(("unorm8",), (4,)), {}, ("none", "", "", "", "")),
    ("missing colours", Description(8, 6, ("R",)), "dds", {"encoding": "b5g6r5"}, ("none", "", "", "", "")),
    ("shared exponents", Description(8, 6, RGB), "hdr", {}, ("convert_sample encode_elements", "RGB", "float32", "rgbe", "8x6 compression,numeric")),
)


@query(_values([(name, *want) for name, _, _, _, want in CASES], "name, steps, channels, sample, encoding, result"))
def plan_rules(spark, sf_dir):
    """The planner's choices by case: order of steps, channels, samples, encodings, extents and losses."""

    def made(i: int) -> tuple:
        name, source, target, what, _ = CASES[i]
        return name, *outcome(source, target, **what)

    return _planned(spark, sf_dir, len(CASES), made, "name, steps, channels, sample, encoding, result")


#: Which policies let which losses pass.
GATES = (
    ("nothing", Description(8, 8, RGB), "png", {}, "strict,preserve,preview,explicit"),
    ("metadata", Description(8, 8, RGB, metadata=("x",)), "png", {}, "preserve,preview,explicit"),
    ("metadata of blocks that pass", Description(8, 8, RGBA, encoding="bc3", metadata=("x",)), "dds", {}, "preview,explicit"),
    ("sampling", Description(8, 8, RGB, subsampled=("B",)), "png", {}, "preserve,preview,explicit"),
    ("turned pixels", Description(8, 8, RGB, orientation="flip_x"), "png", {}, "preserve,preview,explicit"),
    ("wider samples", Description(8, 8, RGB), "exr", {}, "preview,explicit"),
    ("samples", Description(8, 8, RGB, "unorm16"), "jpeg", {}, "preview,explicit"),
    ("dynamic range", Description(8, 8, RGB, "float32"), "png", {}, "preview,explicit"),
    ("channels", Description(8, 8, RGBA), "jpeg", {}, "preview,explicit"),
    ("parts", Description(8, 8, RGB, parts=2), "png", {}, "preserve,preview,explicit"),
    ("blocks", Description(8, 8, RGBA), "dds", {"encoding": "bc1"}, "preview,explicit"),
    ("shared exponents", Description(8, 8, RGB, "float32"), "hdr", {}, "preview,explicit"),
    ("blocks that pass", Description(8, 8, RGBA, encoding="bc3"), "dds", {}, "strict,preserve,preview,explicit"),
    ("a crop that was asked for", Description(8, 8, RGB), "png", {"crop": (0, 0, 4, 4)}, "preserve,preview,explicit"),
)


@query(_values([(name, want) for name, _, _, _, want in GATES], "name, allowed_by"))
def policy_gates(spark, sf_dir):
    def made(i: int) -> tuple:
        name, source, target, what, _ = GATES[i]
        return name, ",".join(p for p in ("strict", "preserve", "preview", "explicit") if outcome(source, target, p, **what)[0] != "none")

    return _planned(spark, sf_dir, len(GATES), made, "name, allowed_by")


@query("SELECT p_partkey, p_partkey % 50 + 1 AS width, sha256('1|preserve|crop(0, 0, ' || (p_partkey % 50 + 1) || ', 8)|orient(flip_y, ' || (p_partkey % 50 + 1) || ', 8)') AS fingerprint FROM part")
def plan_fingerprint(spark, sf_dir):
    """Of the plans that crop to widths 1 to 50 and flip."""

    def made(i: int) -> tuple:
        return str(i + 1), plan(Description(60, 8, RGB, orientation="flip_y"), Capabilities.of(CODECS["png"]), crop=(0, 0, i + 1, 8)).fingerprint()

    return _planned(spark, sf_dir, 50, made, "width, fingerprint").withColumn("width", F.col("width").cast("long"))


@query(f"WITH {PIXELS} SELECT id, n, CAST(r AS INT) AS red FROM px")
def plan_identity(spark, sf_dir):
    """A plan without steps returns what was stored."""
    px = pixels(spark, sf_dir).select(F.col("id").alias("image"), F.col("n").alias("y"), F.lit(0).alias("x"), F.col("r").alias("L"))
    return ImageFrame(px, Description(1, 7, ("Y",))).pixels(CODECS["png"], "strict").select(F.col("image").alias("id"), F.col("y").alias("n"), F.col("L").alias("red"))


#: Why there is no plan.
REFUSALS = (
    ("width 0", Description(8, 8, RGB), "png", {"resize": (0, 4)}, "topology"), ("crop outside", Description(8, 8, RGB), "png", {"crop": (4, 4, 8, 8)}, "topology"),
    ("encoding unknown to the target", Description(8, 8, RGB), "png", {"encoding": "bc1"}, "transcode"), ("no encoder", Description(8, 8, RGBA), "dds", {"encoding": "bc7"}, "transcode"),
    ("no known channel", Description(8, 8, ("Z",)), "png", {}, "channel"), ("colours missing", Description(8, 8, ("R",)), "dds", {"encoding": "bc1"}, "channel"),
    ("no layout for one channel", Description(8, 8, ("R",)), Capabilities(("unorm8",), (4,)), {}, "channel"), ("palette of 4 bits", Description(8, 8, ("I",), indexed=True, palette_bits=4), "png", {}, "transcode"),
    ("strict metadata", Description(8, 8, RGB, metadata=("x",)), "png", {"policy": "strict"}, "metadata"), ("strict crop", Description(8, 8, RGB), "png", {"policy": "strict", "crop": (0, 0, 2, 2)}, "topology"),
    ("preserved samples", Description(8, 8, RGB, "float32"), "png", {"policy": "preserve"}, "dynamic_range"), ("preserved blocks", Description(8, 8, RGBA), "dds", {"policy": "preserve", "encoding": "bc3"}, "compression"),
    ("preserved channels", Description(8, 8, RGBA), "jpeg", {"policy": "preserve"}, "channel"), ("strict orientation", Description(8, 8, RGB, orientation="flip_y"), "png", {"policy": "strict"}, "orientation"),
    ("strict sampling", Description(8, 8, RGB, subsampled=("B",)), "png", {"policy": "strict"}, "sampling"), ("preserved numbers", Description(8, 8, RGB, "unorm16"), "webp", {"policy": "preserve"}, "numeric"),
)


@query(_values([(name, want) for name, _, _, _, want in REFUSALS], "name, category"))
def plan_refusals(spark, sf_dir):
    """The kind of reason for which a plan is refused."""

    def made(i: int) -> tuple:
        name, source, target, what, _ = REFUSALS[i]
        try:
            plan(source, target if isinstance(target, Capabilities) else Capabilities.of(CODECS[target]), **{"policy": "preview"} | what)
        except PlanError as e:
            return name, e.category
        return name, "none"

    return _planned(spark, sf_dir, len(REFUSALS), made, "name, category")
