"""Queries over image files: the embeddings as 8 x 8 images through encoders, decoders and containers, and their SQL.

Lossless codecs have an exact oracle: no error, and no difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imagelake.functions import grid
from imagelake.query_base import RASTER, byte_raster, query, raster, read, spread
from imagelake.sources import bc6h, catalog, dds

LOSSLESS = "SELECT vec_id, 0e0 AS max_error, CAST(NULL AS VARCHAR) AS error FROM embeddings"


def texel(v: Column, sample: str) -> Column:
    """What an image has of a number: a sample of its kind."""
    v = F.abs(v)
    return {"unorm8": F.least(F.floor(v * 255), F.lit(255)), "unorm16": F.least(F.floor(v * 65535), F.lit(65535)), "uint32": F.floor(v * 1e9)}.get(sample, F.floor(v * 64) / 64).cast("double")


def channel(v: Column, k: int, sample: str) -> Column:
    """A texel's sample in its channel k; channels differ, so that swapped ones show."""
    top = {"unorm8": 255.0, "unorm16": 65535.0, "uint32": 4294967295.0}.get(sample)
    return (v if top is None else (v + 37 * k) % (top + 1)) * (1 if top else 1 + k % 2)


def images(spark: SparkSession, sf_dir: str, channels: str, sample: str) -> DataFrame:
    """Rows of catalog.IMAGE_SCHEMA."""
    rows = raster(spark, sf_dir).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", texel(F.col("v"), sample).alias("v")))).alias("t"))
    return pictures(rows.withColumn("t", F.col("t.v")), channels, sample)


def pictures(rows: DataFrame, channels: str, sample: str) -> DataFrame:
    """Rows of catalog.IMAGE_SCHEMA from (vec_id, t), the texels of 8 x 8 images in their order."""
    each = lambda v: F.array(*(channel(v, k, sample) for k in range(len(channels))))
    return rows.select(
        "vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.array(*map(F.lit, channels)).alias("channels"), F.lit(sample).alias("sample"),
        F.lit("identity").alias("orientation"), F.flatten(F.transform("t", each)).alias("samples"),
    )


def round_trip(spark: SparkSession, sf_dir: str, fmt: str, channels: str, sample: str, options: dict, decoding: dict | None = None) -> DataFrame:
    """Each embedding's largest error after encoding and decoding, and the error if there is one."""
    source = images(spark, sf_dir, channels, sample)
    files = catalog.encode_images(source, fmt, options, ("vec_id",))
    back = catalog.decode_images(files, carry=("vec_id",), options=decoding)
    # Formats order channels their own way, and may add an opaque alpha: what was given is found by its name.
    named = F.array(*(F.array_position("_c", c) - 1 for c in channels))
    at = lambda i: F.floor(i / len(channels)) * F.size("_c") + F.get(F.col("_at"), (i % len(channels)).cast("int"))
    back = back.select("vec_id", F.col("samples").alias("_d"), F.col("channels").alias("_c"), F.col("error.code").alias("error")).withColumn("_at", named)
    places = F.sequence(F.lit(0), F.lit(64 * len(channels) - 1))
    back = back.select("vec_id", F.transform(places, lambda i: F.get(F.col("_d"), at(i).cast("int"))).alias("decoded"), "error")
    worst = F.array_max(F.zip_with("samples", "decoded", lambda a, b: F.abs(a - b)))
    return source.join(back, "vec_id").select("vec_id", worst.alias("max_error"), "error")


def _lossless(name: str, *args) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_trip(spark, sf_dir, *args)

    run.__name__ = f"codec_{name}_roundtrip"
    query(LOSSLESS)(run)


for _name, *_args in (
    ("png", "png", "RGB", "unorm8", {}), ("png16", "png", "RGBA", "unorm16", {"effort": "fast"}), ("png_grey", "png", "Y", "unorm8", {"effort": "none"}), ("png_paeth", "png", "YA", "unorm16", {"row_filter": 4}),
    ("exr", "exr", "RGB", "float32", {"compression": "zip"}), ("exr_none", "exr", "RGBA", "float16", {"compression": "none"}), ("exr_rle", "exr", "RGB", "float16", {"compression": "rle"}),
    ("exr_zips", "exr", "RGB", "uint32", {"compression": "zips"}), ("exr_piz", "exr", "RGBA", "float16", {"compression": "piz"}), ("exr_piz32", "exr", "RGB", "float32", {"compression": "piz"}),
    ("exr_tiles", "exr", "RGB", "float16", {"compression": "zip", "tile": (3, 5)}),
    ("hdr", "hdr", "RGB", "float32", {}), ("dds", "dds", "RGBA", "unorm8", {}), ("dds_rg16", "dds", "RG", "unorm16", {}), ("dds_half", "dds", "RGBA", "float16", {}),
    ("ktx2", "ktx2", "RGBA", "unorm8", {"compress": True}), ("ktx2_float", "ktx2", "RG", "float32", {}),
    ("webp_fast", "webp", "RGB", "unorm8", {"effort": "fast"}), ("webp", "webp", "RGBA", "unorm8", {"effort": "balanced"}), ("webp_best", "webp", "RGB", "unorm8", {"effort": "best"}),
):
    _lossless(_name, *_args)


def _lossy(name: str, bound: float, *args) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = round_trip(spark, sf_dir, *args)
        return out.select("vec_id", (F.col("max_error") <= bound).alias("within"), "error")

    run.__name__ = f"codec_{name}_roundtrip"
    query("SELECT vec_id, true AS within, CAST(NULL AS VARCHAR) AS error FROM embeddings")(run)


for _name, _bound, *_args in (
    ("jpeg", 40.0, "RGB", "unorm8", {"quality": 95, "subsampling": "444"}), ("jpeg_grey", 24.0, "Y", "unorm8", {"quality": 95}),
    ("jpeg_progressive", 40.0, "RGB", "unorm8", {"quality": 95, "subsampling": "444", "progressive": True}), ("jpeg_restart", 24.0, "Y", "unorm8", {"quality": 95, "restart": 1}),
):
    _lossy(_name, _bound, "jpeg", *_args)


@query("SELECT vec_id, true AS within, CAST(NULL AS VARCHAR) AS error FROM embeddings")
def codec_webp_lossy_roundtrip(spark, sf_dir):
    """Grey images with alpha through lossy frames, with tables made by a rule: alpha whole, grey near."""
    from imagelake.sources.vp8 import even_tables

    grey = images(spark, sf_dir, "RGBA", "unorm8")
    flat = grey.withColumn("samples", F.transform("samples", lambda v, i: F.when(i % 4 < 3, F.get("samples", i - i % 4)).otherwise(v)))
    tables = even_tables()
    files = catalog.encode_images(flat, "webp", {"lossless": False, "quality": 100, "effort": "best", "tables": tables}, ("vec_id",))
    back = catalog.decode_images(files, carry=("vec_id",), options={"webp": {"tables": tables}})
    back = back.select("vec_id", F.col("samples").alias("decoded"), F.col("error.code").alias("error"))
    near = F.forall(F.zip_with("samples", F.transform("decoded", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda a, b: F.abs(a - b["v"]) <= F.when(b["i"] % 4 < 3, 6).otherwise(0)), lambda ok: ok)
    return flat.join(back, "vec_id").select("vec_id", near.alias("within"), "error")


@query("SELECT vec_id // 128 AS strip, count(*) AS n_images, 0e0 AS max_error, true AS no_larger, CAST(NULL AS VARCHAR) AS error FROM embeddings GROUP BY ALL")
def codec_webp_strips(spark, sf_dir):
    """128 embeddings a picture, one below the other, in runs of whole bytes, few colours and flat ones: the lossless
    encoder's groups of codes, its cache and its copies come back unchanged, in a file no larger than one without them."""
    kind, v = F.floor(F.col("vec_id") / 16) % 4, F.col("samples")
    some = F.transform(v, lambda v: F.when(kind < 2, v).when(kind == 2, F.floor(v / 64) * 64).otherwise(F.floor(v / 256)))
    squares = F.array_sort(F.collect_list(F.struct("vec_id", some.alias("v"))))
    strips = images(spark, sf_dir, "RGB", "unorm8").groupBy(F.floor(F.col("vec_id") / 128).alias("strip"), "width", "channels", "sample", "orientation").agg(F.count(F.lit(1)).alias("n_images"), F.flatten(squares["v"]).alias("samples"))
    strips = strips.withColumns({"height": (F.col("n_images") * 8).cast("int"), "given": F.col("samples")})
    size = catalog.encode_images(strips, "webp", {"effort": "balanced"}, ("strip",)).select("strip", F.length("content").alias("without"))
    files = catalog.encode_images(strips, "webp", {"effort": "best"}, ("strip", "n_images", "given")).drop("error").withColumn("bytes", F.length("content"))
    back = catalog.decode_images(files, carry=("strip", "n_images", "given", "bytes"))
    worst = F.array_max(F.transform("given", lambda v, i: F.abs(v - F.get("samples", (F.floor(i / 3) * 4 + i % 3).cast("int")))))
    return back.join(size, "strip").select("strip", "n_images", worst.alias("max_error"), (F.col("bytes") <= F.col("without")).alias("no_larger"), F.col("error.code").alias("error"))


def png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.encode_images(images(spark, sf_dir, "RGB", "unorm8"), "png", {"effort": "optimal"}, ("vec_id",)).select("vec_id", "content")


@query("SELECT vec_id, CAST(o AS INT) AS ordinal, t AS type, true AS sound, n AS stated FROM embeddings, (VALUES (0, 'IHDR', 13), (1, 'IDAT', NULL), (2, 'IEND', 0)) c(o, t, n)")
def png_chunk_scan(spark, sf_dir):
    """Chunks with the checksum computed anew by the built-in; the length of image data depends on the packer."""
    chunks = catalog.png_chunks(png_files(spark, sf_dir), carry=("vec_id",))
    crc = F.crc32(F.concat(F.encode("type", "ISO-8859-1"), "payload"))
    length = F.when(F.col("type") != "IDAT", F.col("length")).cast("int")
    return chunks.select("vec_id", "ordinal", "type", ((crc == F.col("crc")) & (F.octet_length("payload") == F.col("length"))).alias("sound"), length.alias("stated"))


@query("""SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'rejected' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'resource_limit' ELSE 'rejected' END AS outcome FROM embeddings""")
def decode_outcomes(spark, sf_dir):
    """PNG files whole, cut off, with a broken checksum, with an unknown critical chunk, beyond the limits, and none at all."""
    content, k = F.hex("content"), F.col("vec_id") % 6
    chunk = lambda kind, payload: F.concat(F.lit("00000004"), kind, payload, F.hex(F.crc32(F.unhex(F.concat(kind, payload)))))
    unknown = F.concat(F.substring(content, 1, 66), chunk(F.hex(F.lit("ABCD").cast("binary")), F.lit("01020304")), F.expr("substring(hex(content), 67)"))
    header = F.concat(F.lit("49484452"), F.lit("0001000100000008"), F.lit("0802000000"))
    wide = F.concat(F.lit("89504E470D0A1A0A0000000D"), header, F.lpad(F.hex(F.crc32(F.unhex(header))), 8, "0"), F.expr("substring(hex(content), 67)"))
    made = (
        F.when(k == 1, F.expr("substring(hex(content), 1, 100)")).when(k == 2, F.concat(F.expr("substring(hex(content), 1, 58)"), F.lit("00000000"), F.expr("substring(hex(content), 67)")))
        .when(k == 3, unknown).when(k == 4, wide).when(k == 5, F.lit("0011223344")).otherwise(content)
    )
    files = png_files(spark, sf_dir).withColumn("content", F.unhex(made))
    return catalog.decode_images(files, carry=("vec_id",)).select("vec_id", catalog.outcome(F.col("error")).alias("outcome"))


@query("SELECT count(*) AS files, count(*) * 4 AS decoded, CAST(0 AS BIGINT) AS crashed FROM embeddings")
def mutated_files(spark, sf_dir):
    """Four mutants of every file go through the decoder: each is accepted or gives an error, and none breaks the task."""
    from imagelake.operators.mutate import mutants

    files = png_files(spark, sf_dir)
    out = catalog.decode_images(mutants(files, "vec_id", 4, seed=9), carry=("vec_id", "mutant")).withColumn("outcome", catalog.outcome(F.col("error")))
    crashed = F.count_if(~F.col("outcome").isin("accepted", "rejected", "unsupported", "resource_limit"))
    return out.agg(F.count_distinct("vec_id").alias("files"), F.count(F.lit(1)).alias("decoded"), crashed.alias("crashed"))


@query("""WITH s AS (SELECT n_nationkey AS k, ['accepted', 'rejected', 'unsupported', 'resource_limit', 'crash'][n_nationkey % 5 + 1] AS a, ['accepted', 'rejected', 'crash', NULL, 'unsupported'][n_nationkey // 5 + 1] AS b FROM nation)
SELECT k AS n_nationkey, CASE WHEN a = 'crash' OR b = 'crash' THEN 'failure' WHEN b IS NULL THEN 'not_compared' WHEN a IN ('unsupported', 'resource_limit') OR b IN ('unsupported', 'resource_limit') THEN 'inconclusive'
WHEN a = b THEN 'agreement' ELSE 'acceptance_mismatch' END AS comparison FROM s""")
def differential_comparison(spark, sf_dir):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    k = F.col("n_nationkey")
    ours, other = pick(["accepted", "rejected", "unsupported", "resource_limit", "crash"], k % 5), pick(["accepted", "rejected", "crash", None, "unsupported"], F.floor(k / 5))
    return read(spark, sf_dir, "nation").select("n_nationkey", catalog.compared(ours, other).alias("comparison"))


# ---------------------------------------------------------------- blocks

_BC4_IN = """e AS (SELECT vec_id, c, brow, bcol, t, v, max(v) OVER w AS v0, min(v) OVER w AS v1 FROM ch WINDOW w AS (PARTITION BY vec_id, c, brow, bcol)),
p AS (SELECT *, CASE WHEN v0 > v1 THEN [v0, v1, (6*v0+v1)//7, (5*v0+2*v1)//7, (4*v0+3*v1)//7, (3*v0+4*v1)//7, (2*v0+5*v1)//7, (v0+6*v1)//7] ELSE [v0, v1, v0, v0, v0, v0, 0, 255] END AS pal FROM e),
q AS (SELECT vec_id, c, brow, bcol, t, v, v0, v1, unnest(pal) AS q, generate_subscripts(pal, 1) - 1 AS k FROM p),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY vec_id, c, brow, bcol, t ORDER BY abs(v - q), k) = 1)"""
_CHANNELS = f"{RASTER}, ch AS (SELECT vec_id, y // 4 AS brow, x // 4 AS bcol, y % 4 * 4 + x % 4 AS t, c, CASE c WHEN 0 THEN v ELSE 255 - v END AS v FROM br, (VALUES (0), (1)) z(c))"
_BYTES = """CAST(v0 AS UTINYINT) AS h0, CAST(v1 AS UTINYINT) AS h1, CAST(sum(CAST(k AS BIGINT) << CAST(3 * t AS INT)) AS BIGINT) AS word FROM b GROUP BY vec_id, c, brow, bcol, v0, v1"""
_HEX = "printf('%02x%02x%02x%02x%02x%02x%02x%02x', h0, h1, word & 255, word >> 8 & 255, word >> 16 & 255, word >> 24 & 255, word >> 32 & 255, word >> 40 & 255)"


def _elements(spark: SparkSession, sf_dir: str, kind: str, channels: dict[str, Column]) -> DataFrame:
    from imagelake.operators import blocks

    px = byte_raster(spark, sf_dir).select("vec_id", "y", "x", *(c.alias(n) for n, c in channels.items()))
    return blocks.encode_blocks(px, "vec_id", kind, list(channels))


@query(f"WITH {_CHANNELS}, {_BC4_IN}, w AS (SELECT vec_id, c, brow, bcol, {_BYTES}) SELECT vec_id, CAST(brow AS INT) AS brow, CAST(bcol AS INT) AS bcol, {_HEX} AS element FROM w WHERE c = 0")
def bc4_elements(spark, sf_dir):
    """The bytes of blocks."""
    return _elements(spark, sf_dir, "bc4", {"R": F.col("v")}).withColumn("element", F.lower(F.hex("element")))


@query(f"WITH {_CHANNELS}, {_BC4_IN}, w AS (SELECT vec_id, c, brow, bcol, {_BYTES}), h AS (SELECT vec_id, brow, bcol, c, {_HEX} AS x FROM w) SELECT vec_id, CAST(brow AS INT) AS brow, CAST(bcol AS INT) AS bcol, string_agg(x, '' ORDER BY c) AS element FROM h GROUP BY vec_id, brow, bcol")
def bc5_elements(spark, sf_dir):
    return _elements(spark, sf_dir, "bc5", {"R": F.col("v"), "G": 255 - F.col("v")}).withColumn("element", F.lower(F.hex("element")))


@query(f"WITH {_CHANNELS}, {_BC4_IN} SELECT vec_id, CAST(brow * 4 + t // 4 AS INT) AS y, CAST(bcol * 4 + t % 4 AS INT) AS x, CAST(max(q) FILTER (WHERE c = 0) AS INT) AS red, CAST(max(q) FILTER (WHERE c = 1) AS INT) AS green FROM b GROUP BY vec_id, brow, bcol, t")
def bc5_decoded(spark, sf_dir):
    from imagelake.operators import blocks

    coded = _elements(spark, sf_dir, "bc5", {"R": F.col("v"), "G": 255 - F.col("v")})
    return blocks.decode_blocks(coded, "vec_id", "bc5", ["red", "green"], 8, 8)


@query(f"WITH {_CHANNELS}, {_BC4_IN} SELECT vec_id, CAST(brow * 4 + t // 4 AS INT) AS y, CAST(bcol * 4 + t % 4 AS INT) AS x, 66 AS red, CAST(q AS INT) AS alpha FROM b WHERE c = 0")
def bc3_decoded(spark, sf_dir):
    """Alpha as in BC4, and a flat colour: 8 of 31 stands for 66."""
    from imagelake.operators import blocks

    coded = _elements(spark, sf_dir, "bc3", {"R": F.lit(66), "G": F.lit(65), "B": F.lit(66), "A": F.col("v")})
    return blocks.decode_blocks(coded, "vec_id", "bc3", ["red", "green", "blue", "alpha"], 8, 8).select("vec_id", "y", "x", "red", "alpha")


@query(f"WITH {RASTER} SELECT vec_id, y, x, least(15, (v + 8) // 17) * 17 AS alpha FROM br")
def bc2_decoded(spark, sf_dir):
    from imagelake.operators import blocks

    coded = _elements(spark, sf_dir, "bc2", {"R": F.lit(0), "G": F.lit(0), "B": F.lit(0), "A": F.col("v")})
    return blocks.decode_blocks(coded, "vec_id", "bc2", ["red", "green", "blue", "alpha"], 8, 8).select("vec_id", "y", "x", "alpha")


@query(f"""WITH {RASTER}, t AS (SELECT vec_id, y // 4 AS brow, x // 4 AS bcol, y % 4 * 4 + x % 4 AS t, v AS r, (v * 7 + 3) % 256 AS g, 255 - v AS b FROM br),
p AS (SELECT a.vec_id, a.brow, a.bcol, a.t AS i, b.t AS j, (a.r-b.r)*(a.r-b.r)+(a.g-b.g)*(a.g-b.g)+(a.b-b.b)*(a.b-b.b) AS d, (a.r//8)*2048+(a.g//4)*32+a.b//8 AS pa, (b.r//8)*2048+(b.g//4)*32+b.b//8 AS pb
FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.brow = b.brow AND a.bcol = b.bcol),
e AS (SELECT vec_id, brow, bcol, greatest(pa, pb) AS c0, least(pa, pb) AS c1 FROM p QUALIFY row_number() OVER (PARTITION BY vec_id, brow, bcol ORDER BY d DESC, i, j) = 1),
u AS (SELECT *, c0 // 2048 AS r0, c0 // 32 % 64 AS g0, c0 % 32 AS b0, c1 // 2048 AS r1, c1 // 32 % 64 AS g1, c1 % 32 AS b1 FROM e),
x AS (SELECT *, [r0 * 8 + r0 // 4, g0 * 4 + g0 // 16, b0 * 8 + b0 // 4] AS a, [r1 * 8 + r1 // 4, g1 * 4 + g1 // 16, b1 * 8 + b1 // 4] AS b FROM u),
k AS (SELECT vec_id, brow, bcol, n, CASE n WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN CASE WHEN c0 > c1 THEN [(2 * a[1] + b[1]) // 3, (2 * a[2] + b[2]) // 3, (2 * a[3] + b[3]) // 3] ELSE [(a[1] + b[1]) // 2, (a[2] + b[2]) // 2, (a[3] + b[3]) // 2] END
  ELSE CASE WHEN c0 > c1 THEN [(a[1] + 2 * b[1]) // 3, (a[2] + 2 * b[2]) // 3, (a[3] + 2 * b[3]) // 3] ELSE [0, 0, 0] END END AS q, CASE WHEN n = 3 AND c0 <= c1 THEN 0 ELSE 255 END AS alpha FROM x, range(4) z(n)),
m AS (SELECT t.vec_id, t.brow, t.bcol, t.t, k.q, k.alpha, (t.r - q[1]) * (t.r - q[1]) + (t.g - q[2]) * (t.g - q[2]) + (t.b - q[3]) * (t.b - q[3]) AS d, k.n FROM t JOIN k ON k.vec_id = t.vec_id AND k.brow = t.brow AND k.bcol = t.bcol)
SELECT vec_id, CAST(brow * 4 + t // 4 AS INT) AS y, CAST(bcol * 4 + t % 4 AS INT) AS x, CAST(q[1] AS INT) AS red, CAST(q[2] AS INT) AS green, CAST(q[3] AS INT) AS blue, alpha FROM m QUALIFY row_number() OVER (PARTITION BY vec_id, brow, bcol, t ORDER BY d, n) = 1""")
def bc1_decoded(spark, sf_dir):
    """All texels after encoding and decoding: endpoints, the nearest colour, and colours made of endpoints."""
    from imagelake.operators import blocks

    v = F.col("v")
    coded = _elements(spark, sf_dir, "bc1", {"R": v, "G": (v * 7 + 3) % 256, "B": 255 - v})
    return blocks.decode_blocks(coded, "vec_id", "bc1", ["red", "green", "blue", "alpha"], 8, 8)


def _word(parts: list[tuple[Column, int]]) -> Column:
    """Sixteen bytes from (value, bits) fields, the first in the lowest bits, as binary."""
    digits = F.concat(*(F.lpad(F.conv(c.cast("string"), 10, 2), n, "0") for c, n in reversed(parts)))
    return F.unhex(F.concat(*(F.lpad(F.conv(F.substring(digits, 121 - 8 * k, 8), 2, 16), 2, "0") for k in range(16))))


@query("""SELECT p_partkey, CAST(t // 4 AS INT) AS y, CAST(t % 4 AS INT) AS x, CAST((p_partkey % 128) * 2 + p_partkey % 2 AS INT) AS red, CAST((p_size % 128) * 2 + p_partkey % 2 AS INT) AS green,
CAST(((p_partkey + p_size) % 128) * 2 + p_partkey % 2 AS INT) AS blue, 254 + CAST(p_partkey % 2 AS INT) AS alpha FROM part, range(16) r(t)""")
def bc7_decoded(spark, sf_dir):
    """Blocks of mode 6 with equal endpoints: seven bits a channel and a shared lowest one, the same in every texel."""
    from imagelake.operators import blocks

    k, s, low = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 2
    ends = [x for c in (k % 128, s % 128, (k + s) % 128, F.lit(127)) for x in ((c, 7), (c, 7))]
    element = _word([(F.lit(64), 7), *ends, (low, 1), (low, 1), (F.lit(0), 63)])
    b = read(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("brow"), F.lit(0).alias("bcol"), element.alias("element"))
    return blocks.decode_blocks(b, "p_partkey", "bc7", ["red", "green", "blue", "alpha"], 4, 4)


@query("""WITH e AS (SELECT p_partkey, unnest([p_partkey % 1024, p_size * 20 % 1024, (p_partkey + p_size) % 1024]) AS q, generate_subscripts([1, 2, 3], 1) AS c FROM part),
u AS (SELECT p_partkey, c, CASE WHEN q = 0 THEN 0 WHEN q = 1023 THEN 65535 ELSE (q * 65536 + 32768) // 1024 END AS u FROM e),
h AS (SELECT p_partkey, c, u * 31 // 64 AS h FROM u)
SELECT p_partkey, CAST(t // 4 AS INT) AS y, CAST(t % 4 AS INT) AS x, CAST(max(h) FILTER (WHERE c = 1) AS INT) AS red, CAST(max(h) FILTER (WHERE c = 2) AS INT) AS green, CAST(max(h) FILTER (WHERE c = 3) AS INT) AS blue FROM h, range(16) r(t) GROUP BY p_partkey, t""")
def bc6h_decoded(spark, sf_dir):
    """Blocks of the mode with plain endpoints of ten bits, both equal: the half words of every texel."""
    k, s = F.col("p_partkey"), F.col("p_size")
    ends = [k % 1024, s * 20 % 1024, (k + s) % 1024]
    element = _word([(F.lit(3), 5), *((c, 10) for c in ends), *((c, 10) for c in ends), (F.lit(0), 63)])
    b = read(spark, sf_dir, "part").select("p_partkey", element.alias("element"))
    return bc6h.decode_words(b, "p_partkey", signed=False)


# ---------------------------------------------------------------- formats

_FORMATS = ", ".join(
    f"('{n}', {b}, {s})"
    for n, b, s in (
        ("r8", 1, 1), ("rg8", 1, 2), ("rgba8", 1, 4), ("r16", 1, 2), ("rg16", 1, 4), ("rgba16", 1, 8), ("r16f", 1, 2), ("rg16f", 1, 4), ("rgba16f", 1, 8), ("r32f", 1, 4), ("rg32f", 1, 8), ("rgba32f", 1, 16),
        ("r10g10b10a2", 1, 4), ("r11g11b10f", 1, 4), ("rgb9e5", 1, 4), ("b5g6r5", 1, 2), ("b5g5r5a1", 1, 2), ("bc1", 4, 8), ("bc2", 4, 16), ("bc3", 4, 16), ("bc4", 4, 8), ("bc5", 4, 16), ("bc6h", 4, 16), ("bc6h_signed", 4, 16), ("bc7", 4, 16),
    )
)


@query(f"""SELECT p_partkey, f AS format, (p_size + b - 1) // b * s AS row_bytes, (p_size + b - 1) // b * s * ((p_partkey % 97 + b) // b) AS slice_bytes FROM part, (VALUES {_FORMATS}) t(f, b, s)""")
def texture_pitches(spark, sf_dir):
    """Bytes of a row and of a slice in every texture format."""
    table = F.broadcast(spark.createDataFrame([(k, v[4], v[5]) for k, v in dds.FORMATS.items()], "format string, b int, s int"))  # one row per format
    w, h = F.col("p_size").cast("long"), F.col("p_partkey") % 97 + 1
    blocks = lambda v: F.ceil(v / F.col("b")).cast("long")
    return read(spark, sf_dir, "part").crossJoin(table).select("p_partkey", "format", (blocks(w) * F.col("s")).alias("row_bytes"), (blocks(w) * F.col("s") * blocks(h)).alias("slice_bytes"))


def _picked(spark: SparkSession, sf_dir: str, rows: list[tuple], names: str) -> DataFrame:
    """Each part with one of some rows, by its key; a catalogue has a fixed, small number of them."""
    listed = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k long, {names}")
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(rows)).alias("_k")).join(F.broadcast(listed), "_k").drop("_k")


@query("""WITH c AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES ('png', 'unorm1,unorm16,unorm2,unorm4,unorm8', '1,2,3,4', false, false, 1, 'increasing', false), ('jpeg', 'unorm8', '1,3', false, false, 0, 'increasing', false),
('exr', 'float16,float32,uint32', NULL, true, true, 16, 'arbitrary', true), ('hdr', 'float32', '3', false, false, 1, 'increasing', false), ('dds', 'float16,float32,unorm16,unorm8', '1,2,4', false, false, 4, 'increasing', false),
('ktx2', 'float16,float32,unorm16,unorm8', '1,2,4', false, false, 0, 'arbitrary', true), ('webp', 'unorm8', '3,4', false, false, 0, 'increasing', false)) t(format, samples, channel_counts, names, parts, granularity, write_order, seekable))
SELECT p_partkey, c.* EXCLUDE (k) FROM part JOIN c ON k = p_partkey % 7""")
def format_catalogue(spark, sf_dir):
    """Capabilities and writers' contracts of the registered codecs, one for each part."""
    rows = [
        (c.format, ",".join(sorted(c.samples)), ",".join(map(str, c.channel_counts)) if c.channel_counts else None, c.arbitrary_names, c.multipart, c.contract.granularity, c.contract.order, c.contract.seekable)
        for c in catalog.REGISTRY.codecs.values()
    ]
    return _picked(spark, sf_dir, rows, "format string, samples string, channel_counts string, names boolean, parts boolean, granularity int, write_order string, seekable boolean")


@query("""WITH c AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES ('png', 'compression', 'choice', 'smallest', 'none,fast,optimal,smallest'), ('png', 'filter', 'choice', 'adaptive', 'adaptive,none,sub,up,average,paeth'), ('jpeg', 'quality', 'integer', '90', '1..100'),
('jpeg', 'chroma-subsampling', 'choice', '420', '444,422,420'), ('jpeg', 'progressive', 'boolean', 'false', 'true,false'), ('jpeg', 'restart-interval', 'integer', '0', '0..65535'), ('webp', 'lossless', 'boolean', 'true', 'true,false'), ('webp', 'quality', 'integer', '75', '0..100'), ('webp', 'effort', 'choice', 'balanced', 'fast,balanced,best'),
('exr', 'compression', 'choice', 'zip', 'none,rle,zips,zip,piz'), ('ktx2', 'compression', 'choice', 'none', 'none,zlib')) t(format, option, kind, preset, allowed))
SELECT p_partkey, c.* EXCLUDE (k) FROM part JOIN c ON k = p_partkey % 11""")
def option_catalogue(spark, sf_dir):
    from imagelake.sources.options import OPTIONS

    allowed = lambda o: f"{o.low}..{o.high}" if o.kind == "integer" else "true,false" if o.kind == "boolean" else ",".join(k for k, _ in o.choices)
    rows = [(f, o.name, o.kind, o.default, allowed(o)) for f, options in OPTIONS.items() for o in options]
    return _picked(spark, sf_dir, rows, "format string, option string, kind string, preset string, allowed string")


@query(f"WITH {RASTER}, r AS (SELECT vec_id, y, CASE y % 4 WHEN 3 THEN y * 36 ELSE v END AS v FROM br) SELECT vec_id, y, CAST(k AS INT) AS filter_kind, true AS same FROM r, range(4) t(k) GROUP BY vec_id, y, k")
def alpha_filters_inverted(spark, sf_dir):
    """The four filters of alpha planes, applied as expressions and undone by the decoder."""
    from imagelake.operators.alpha import filtered_planes, restored_planes

    a = byte_raster(spark, sf_dir).withColumn("v", F.when(F.col("y") % 4 == 3, F.col("y") * 36).otherwise(F.col("v")).cast("int"))
    back = restored_planes(filtered_planes(a, "vec_id"), "vec_id", 8, 8)
    both = back.join(a, ["vec_id", "y", "x"])
    return both.groupBy("vec_id", "y", "filter_kind").agg(F.bool_and(F.col("v") == F.col("restored")).alias("same"))


# ---------------------------------------------------------------- levels and whole files


@query(f"""WITH {RASTER}, m AS (SELECT vec_id, CAST(l AS INT) AS level, CAST(y >> l AS INT) AS y, CAST(x >> l AS INT) AS x, avg(floor(abs(v) * 64) / 64) AS v FROM rs, range(4) t(l) GROUP BY vec_id, l, y >> l, x >> l)
SELECT vec_id, f AS format, level, CAST(8 >> level AS INT) AS width, round(sum(v * (y * 8 + x + 1)), 6) AS weighed FROM m, (VALUES ('exr'), ('dds'), ('ktx2')) t(f) GROUP BY vec_id, f, level""")
def mip_containers(spark, sf_dir):
    """Mip levels through the three containers that hold them: each level's extent, and a sum that tells its pixels apart."""
    out = None
    for fmt, options in (("exr", {"compression": "zip", "tile": (4, 4), "levels": 1}), ("dds", {}), ("ktx2", {"compress": True})):
        files = catalog.encode_images(images(spark, sf_dir, "R", "float32"), fmt, options, ("vec_id",), with_mips=True)
        levels = catalog.decode_levels(files, carry=("vec_id",))
        place = lambda i: F.floor(i / F.col("width")) * 8 + i % F.col("width") + 1
        weighed = F.aggregate(F.transform("samples", lambda v, i: v * place(i)), F.lit(0.0), lambda a, v: a + v)
        one = levels.select("vec_id", F.lit(fmt).alias("format"), F.col("level_x").alias("level"), "width", F.round(weighed, 6).alias("weighed"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {RASTER}, u AS (SELECT vec_id, y, x, CAST(least(floor(abs(v) * 255), 255) AS INT) AS v FROM rs)
SELECT vec_id, CAST(y - 2 AS INT) AS y, CAST(x - 1 AS INT) AS x, v AS red, (v + 37) % 256 AS green, (v + 74) % 256 AS blue FROM u WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 6""")
def converted_files(spark, sf_dir):
    """PNG files cropped and written as WebP, read back as pixels."""
    from imagelake.plans.convert import Request, convert_files

    made = convert_files(png_files(spark, sf_dir), Request("webp", crop=(1, 2, 4, 5)), carry=("vec_id",))
    px = catalog.to_pixels(catalog.decode_images(made.select("vec_id", "content"), carry=("vec_id",)), "vec_id")
    value = lambda c: F.max(F.when(F.col("channel") == c, F.col("value"))).cast("int")
    return px.groupBy("vec_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(value("R").alias("red"), value("G").alias("green"), value("B").alias("blue"))


@query("SELECT vec_id, true AS fits, true AS best FROM embeddings")
def target_size_files(spark, sf_dir):
    """JPEG files of at most 330 bytes where any quality gives one: the file fits or has the lowest quality, and of the
    tenth qualities none above it fits."""
    from imagelake.plans.convert import Request, convert_files

    source = png_files(spark, sf_dir)
    made = convert_files(source, Request("jpeg", target_bytes=330), carry=("vec_id",)).select("vec_id", F.octet_length("content").alias("bytes"), "quality", "reached")
    every = None
    for q in range(10, 101, 10):
        one = convert_files(source, Request("jpeg", options=(("quality", str(q)),)), carry=("vec_id",)).select("vec_id", F.lit(q).alias("q"), F.octet_length("content").alias("size"))
        every = one if every is None else every.unionByName(one)
    fits = F.when(F.col("reached"), F.col("bytes") <= 330).otherwise(F.col("quality") == 1)
    above = every.join(made, "vec_id").filter("q > quality").groupBy("vec_id").agg(F.bool_and(F.col("size") > 330).alias("above"))
    return made.join(above, "vec_id", "left").select("vec_id", fits.alias("fits"), F.coalesce("above", F.lit(True)).alias("best"))


@query("""SELECT vec_id, 'png' AS namespace, 'gamma' AS key, '0.45455' AS value FROM embeddings UNION ALL SELECT vec_id, 'png', 'chromaticities', '0.3127 0.329 0.64 0.33 0.3 0.6 0.15 0.06' FROM embeddings
UNION ALL SELECT vec_id, 'png.text', 'Title', 'vector ' || vec_id || ' é' FROM embeddings UNION ALL SELECT vec_id, 'png.text', 'Ort', 'Köln ' || vec_id FROM embeddings""")
def png_metadata_chunks(spark, sf_dir):
    """Gamma, chromaticities, Latin-1 and UTF-8 texts that were put into files."""
    k = F.col("vec_id").cast("string")

    def chunk(kind: str, payload: Column) -> Column:
        body = F.concat(F.hex(F.lit(kind).cast("binary")), F.hex(payload))
        return F.concat(F.lpad(F.hex(F.octet_length(payload)), 8, "0"), body, F.lpad(F.hex(F.crc32(F.unhex(body))), 8, "0"))

    word = lambda *values: F.unhex(F.lit("".join(f"{v:08x}" for v in values)))
    nul = F.unhex(F.lit("00"))
    made = F.concat(
        chunk("gAMA", word(45455)), chunk("cHRM", word(31270, 32900, 64000, 33000, 30000, 60000, 15000, 6000)),
        chunk("tEXt", F.concat(F.lit("Title").cast("binary"), nul, F.encode(F.concat(F.lit("vector "), k, F.lit(" é")), "ISO-8859-1"))),
        chunk("iTXt", F.concat(F.lit("Ort").cast("binary"), F.unhex(F.lit("0000000000")), F.encode(F.concat(F.lit("Köln "), k), "UTF-8"))),
    )
    whole = F.unhex(F.concat(F.substring(F.hex("content"), 1, 66), made, F.expr("substring(hex(content), 67)")))
    return catalog.png_metadata(png_files(spark, sf_dir).select("vec_id", whole.alias("content")), carry=("vec_id",))


@query("""SELECT p_partkey, c AS compression, CAST(p_partkey % 500 - 7 AS INT) AS y, CAST((p_partkey % 500) // n AS INT) AS chunk FROM part, (VALUES ('none', 1), ('rle', 1), ('zips', 1), ('zip', 16), ('piz', 32)) t(c, n)""")
def exr_chunks(spark, sf_dir):
    """Rows of a window that begins at -7, by the chunk that holds them, for each compression."""
    from imagelake.sources.exr import COMPRESSIONS

    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 500 - 7).cast("int").alias("y"))
    known = [(name, lines) for name, lines in COMPRESSIONS.values() if name in ("none", "rle", "zips", "zip", "piz")]
    each = F.array(*(F.struct(F.lit(name).alias("compression"), grid.chunk_of(F.col("y"), -7, lines).alias("chunk")) for name, lines in known))
    return rows.select("p_partkey", "y", F.inline(each)).select("p_partkey", "compression", "y", "chunk")


_FIELDS = "('r10g10b10a2', 'r', 0, 10), ('r10g10b10a2', 'g', 10, 10), ('r10g10b10a2', 'b', 20, 10), ('r10g10b10a2', 'a', 30, 2), ('b5g6r5', 'b', 0, 5), ('b5g6r5', 'g', 5, 6), ('b5g6r5', 'r', 11, 5), ('b5g5r5a1', 'b', 0, 5), ('b5g5r5a1', 'g', 5, 5), ('b5g5r5a1', 'r', 10, 5), ('b5g5r5a1', 'a', 15, 1), ('r11g11b10f', 'r', 0, 11), ('r11g11b10f', 'g', 11, 11), ('r11g11b10f', 'b', 22, 10), ('rgb9e5', 'r', 0, 9), ('rgb9e5', 'g', 9, 9), ('rgb9e5', 'b', 18, 9), ('rgb9e5', 'e', 27, 5)"


@query(f"SELECT p_partkey, f AS format, c AS field, (p_partkey * 2654435761 % 4294967296) >> b & ((1 << n) - 1) AS value FROM part, (VALUES {_FIELDS}) t(f, c, b, n)")
def packed_fields(spark, sf_dir):
    """Every field of every packed format, taken from words of all bits."""
    from imagelake.functions.packed import FIELDS, field

    word = F.pmod(F.col("p_partkey") * 2654435761, F.lit(4294967296))
    each = F.array(*(F.struct(F.lit(f).alias("format"), F.lit(c).alias("field"), field(word, at, n).alias("value")) for f, fields in FIELDS.items() for c, at, n in fields))
    return read(spark, sf_dir, "part").select("p_partkey", F.inline(each))


_TEXTS = """t AS (SELECT p_partkey, unnest([struct_pack(k := 'Title', v := p_name), struct_pack(k := 'Author', v := p_brand), struct_pack(k := 'Comment', v := p_type), struct_pack(k := 'Stock Size', v := CAST(p_size AS VARCHAR))], recursive := true) FROM part)"""


@query(f"""WITH {_TEXTS} SELECT p_partkey, 'exr' AS format, 'exr' AS namespace, CASE k WHEN 'Comment' THEN 'comments' ELSE k END AS key, v AS value FROM t
UNION ALL SELECT p_partkey, 'ktx2', 'ktx2', k, v FROM t UNION ALL SELECT p_partkey, 'png', 'png.text', k, v FROM t""")
def metadata_translated(spark, sf_dir):
    """Each part's texts in a small PNG, through an EXR and a KTX2 file and back: what every file says, under its own names."""
    from imagelake.plans.convert import Request, convert_chain
    from imagelake.sources.metadata import file_metadata

    texts = F.create_map(F.lit("Title"), "p_name", F.lit("Author"), "p_brand", F.lit("Comment"), "p_type", F.lit("Stock Size"), F.col("p_size").cast("string"))
    samples = F.transform(F.sequence(F.lit(0), F.lit(47)), lambda i: ((F.col("p_partkey") + 7 * i) % 256).cast("double"))
    parts = spread(read(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", F.lit(4).alias("width"), F.lit(4).alias("height"), F.array(*map(F.lit, "RGB")).alias("channels"), F.lit("unorm8").alias("sample"), F.lit("identity").alias("orientation"),
        samples.alias("samples"), texts.alias("texts"),
    )
    files, formats = catalog.encode_images(parts, "png", carry=("p_partkey",), texts="texts"), ("exr", "ktx2", "png")
    made = convert_chain(files, [Request(to, metadata="keep") for to in formats], carry=("p_partkey",))  # each file of the one before
    named = made.select("p_partkey", F.get(F.array(*map(F.lit, formats)), "step").alias("format"), "content")
    return file_metadata(named, ("p_partkey", "format")).drop("ordinal")
