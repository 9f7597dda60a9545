"""BC7 and BC6H blocks of all modes, from digests of the parts' keys, and SQL that takes their fields bit by bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imagelake.query_base import query, read
from imagelake.sources import bc6h, bc7

BC6H_MODES = tuple(bc6h.MODES)


def digest_block(key: Column, mode_bits: Column, mode: Column) -> Column:
    """Sixteen bytes: the MD5 of a key, with the lowest bits of the first byte replaced by a mode."""
    h = F.md5(key.cast("string"))
    one = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    step = F.pow(F.lit(2), mode_bits).cast("int")
    first = F.floor(one / step).cast("int") * step + mode
    return F.unhex(F.concat(F.lpad(F.hex(first), 2, "0"), F.substring(h, 3, 30)))


def _num(start: str, n: str) -> str:
    """SQL: n bits of a block, whose bytes are the list b, from `start` on."""
    return f"coalesce(list_sum(list_transform(range({n}), lambda i: (b[CAST(({start} + i) // 8 AS INT) + 1] >> CAST(({start} + i) % 8 AS INT) & 1) << CAST(i AS INT))), 0)"


_WEIGHTS = " ".join(f"WHEN {n} THEN {list(w)}" for n, w in bc7.WEIGHTS.items())
_PARTITIONS = ", ".join(f"({n}, {p}, '{s}', {a}, {b})" for n, rows, seconds, thirds in ((2, bc7.TWO, bc7.ANCHOR_TWO, [16] * 64), (3, bc7.THREE, bc7.ANCHOR_SECOND, bc7.ANCHOR_THIRD)) for p, (s, a, b) in enumerate(zip(rows, seconds, thirds, strict=True)))
_BYTES = "[('0x' || substr(h, 2 * i + 1, 2))::INT for i in range(16)]"
_BC7 = f"""WITH md AS (SELECT * FROM (VALUES {", ".join(str((m, *v)) for m, v in enumerate(bc7.MODES))}) t(m, ns, pb, rb, sb, cb, ab, pe, ps, ib, ib2)),
pt AS (SELECT * FROM (VALUES {_PARTITIONS}, (1, 0, '0000000000000000', 16, 16)) t(ns, p, s, a1, a2)),
h AS (SELECT p_partkey AS k, p_partkey % 8 AS m, md5(p_partkey::VARCHAR) AS h FROM part),
e0 AS (SELECT k, m, {_BYTES} AS b FROM h),
e AS (SELECT k, m, list_prepend((b[1] >> CAST(m + 1 AS INT) << CAST(m + 1 AS INT)) | (1 << CAST(m AS INT)), b[2:16]) AS b FROM e0),
f0 AS (SELECT e.*, md.* EXCLUDE (m), {_num("m + 1", "pb")} AS part, {_num("m + 1 + pb", "rb")} AS rot, {_num("m + 1 + pb + rb", "sb")} AS sel, m + 1 + pb + rb + sb AS c0 FROM e JOIN md USING (m)),
f1 AS (SELECT *, c0 + 6 * ns * cb AS a0, c0 + 6 * ns * cb + 2 * ns * ab AS x0 FROM f0),
f2 AS (SELECT *, x0 + 2 * ns * pe + ns * ps AS i0, x0 + 2 * ns * pe + ns * ps + 16 * ib - ns AS j0 FROM f1),
f AS (SELECT f2.*, pt.s, pt.a1, pt.a2 FROM f2 JOIN pt ON pt.ns = f2.ns AND pt.p = f2.part),
tx AS (SELECT *, substr(s, CAST(t + 1 AS INT), 1)::INT AS sub, (t > 0)::INT + (a1 < t)::INT + (a2 < t)::INT AS before, (t = 0 OR t = a1 OR t = a2)::INT AS anchor FROM f, range(16) r(t)),
ix AS (SELECT *, {_num("i0 + ib * t - before", "ib - anchor")} AS k1, {_num("j0 + ib2 * t - (t > 0)::INT", "greatest(ib2 - (t = 0)::INT, 0)")} AS k2 FROM tx),
w AS (SELECT *, (CASE ib {_WEIGHTS} END)[CAST(k1 AS INT) + 1] AS w1, CASE WHEN ib2 > 0 THEN (CASE ib2 {_WEIGHTS} END)[CAST(k2 AS INT) + 1] END AS w2 FROM ix),
q AS (SELECT *, CASE WHEN c < 3 THEN cb ELSE ab END AS bits, CASE WHEN c < 3 THEN c0 + (c * ns + sub) * 2 * cb ELSE a0 + sub * 2 * ab END AS q0,
  CASE WHEN ib2 = 0 THEN w1 WHEN (c < 3) = (sel = 0) THEN w1 ELSE w2 END AS w FROM w, range(4) z(c)),
v0 AS (SELECT *, {_num("q0", "bits")} AS lo, {_num("q0 + bits", "bits")} AS hi, CASE WHEN pe = 1 THEN {_num("x0 + sub * 2", "1")} WHEN ps = 1 THEN {_num("x0 + sub", "1")} ELSE 0 END AS xl,
  CASE WHEN pe = 1 THEN {_num("x0 + sub * 2 + 1", "1")} WHEN ps = 1 THEN {_num("x0 + sub", "1")} ELSE 0 END AS xh, CAST(bits + pe + ps AS INT) AS n FROM q),
v1 AS (SELECT *, CASE WHEN pe + ps = 1 THEN lo * 2 + xl ELSE lo END AS l1, CASE WHEN pe + ps = 1 THEN hi * 2 + xh ELSE hi END AS h1 FROM v0),
v2 AS (SELECT *, CASE WHEN bits = 0 THEN 255 ELSE (CAST(l1 AS BIGINT) << (8 - n)) | (CAST(l1 AS BIGINT) >> greatest(2 * n - 8, 0)) END AS l2, CASE WHEN bits = 0 THEN 255 ELSE (CAST(h1 AS BIGINT) << (8 - n)) | (CAST(h1 AS BIGINT) >> greatest(2 * n - 8, 0)) END AS h2 FROM v1),
px AS (SELECT k, t, CASE WHEN rot = 0 THEN c WHEN c = 3 THEN rot - 1 WHEN c = rot - 1 THEN 3 ELSE c END AS c, ((64 - w) * l2 + w * h2 + 32) // 64 AS v FROM v2)
SELECT k AS p_partkey, CAST(t // 4 AS INT) AS y, CAST(t % 4 AS INT) AS x, CAST(max(v) FILTER (WHERE c = 0) AS INT) AS red, CAST(max(v) FILTER (WHERE c = 1) AS INT) AS green,
CAST(max(v) FILTER (WHERE c = 2) AS INT) AS blue, CAST(max(v) FILTER (WHERE c = 3) AS INT) AS alpha FROM px GROUP BY k, t"""


@query(_BC7)
def bc7_all_modes(spark, sf_dir):
    """Blocks of eight modes: partitions, rotations, both sets of indices, anchors and shared bits, all from digests."""
    from imagelake.operators import blocks

    k = F.col("p_partkey")
    mode = (k % 8).cast("int")
    element = digest_block(k, mode + 1, F.pow(F.lit(2), mode).cast("int"))
    b = read(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("brow"), F.lit(0).alias("bcol"), element.alias("element"))
    return blocks.decode_blocks(b, "p_partkey", "bc7", ["red", "green", "blue", "alpha"], 4, 4)


_LAYOUT = ", ".join(f"({m}, {k + (2 if m < 2 else 5)}, '{name}', {bit})" for m, bits in bc6h.LAYOUTS.items() for k, (name, bit) in enumerate(bits))
_BC6H_MODES = ", ".join(f"({m}, {first}, {list(others)}, {delta}, {2 if ('d', 0) in bc6h.LAYOUTS[m] else 1}, {len(bc6h.LAYOUTS[m]) + (2 if m < 2 else 5)})" for m, (first, others, delta, _) in bc6h.MODES.items())
_SX = "({0} - (({0} >> CAST({1} - 1 AS INT) & 1) << CAST({1} AS INT)))"
_BC6H = f"""WITH lay AS (SELECT * FROM (VALUES {_LAYOUT}) t(m, pos, name, bit)), md AS (SELECT * FROM (VALUES {_BC6H_MODES}) t(m, first, others, delta, ns, i0)),
pt AS (SELECT * FROM (VALUES {_PARTITIONS}, (1, 0, '0000000000000000', 16, 16)) t(ns, p, s, a1, a2)),
h AS (SELECT p_partkey AS k, {list(BC6H_MODES)}[p_partkey % 14 + 1] AS m, md5(p_partkey::VARCHAR) AS h FROM part),
e0 AS (SELECT k, m, {_BYTES} AS b FROM h),
e AS (SELECT k, m, list_prepend((b[1] >> CASE WHEN m < 2 THEN 2 ELSE 5 END << CASE WHEN m < 2 THEN 2 ELSE 5 END) | m, b[2:16]) AS b FROM e0),
fv AS (SELECT k, name, CAST(sum((b[pos // 8 + 1] >> (pos % 8) & 1) << bit) AS BIGINT) AS v FROM e JOIN lay USING (m) GROUP BY k, name),
en AS (SELECT e.k, md.*, c, n, fv.v AS raw, base.v AS base, others[CAST(c AS INT) + 1] AS bits FROM e JOIN md USING (m), range(3) a(c), range(4) z(n), fv, fv AS base
  WHERE n < 2 * ns AND fv.k = e.k AND fv.name = substr('rgb', CAST(c + 1 AS INT), 1) || substr('wxyz', CAST(n + 1 AS INT), 1) AND base.k = e.k AND base.name = substr('rgb', CAST(c + 1 AS INT), 1) || 'w'),
ev AS (SELECT k, c, n, first, CASE WHEN n > 0 AND delta THEN (base + {_SX.format("raw", "bits")}) & ((1 << first) - 1) ELSE raw END AS v FROM en),
ew AS (SELECT k, c, n, CASE WHEN first >= 15 OR v = 0 THEN v WHEN v = (1 << first) - 1 THEN 65535 ELSE ((v << 16) + 32768) >> first END AS v FROM ev),
bl AS (SELECT e.k, e.b, md.ns, md.i0, coalesce(fv.v, 0) AS part FROM e JOIN md USING (m) LEFT JOIN fv ON fv.k = e.k AND fv.name = 'd'),
tx AS (SELECT bl.*, t, substr(s, CAST(t + 1 AS INT), 1)::INT AS sub, CASE bl.ns WHEN 2 THEN 3 ELSE 4 END AS ib, (t > 0)::INT + (a1 < t)::INT + (a2 < t)::INT AS before, (t = 0 OR t = a1 OR t = a2)::INT AS anchor
  FROM bl JOIN pt ON pt.ns = bl.ns AND pt.p = bl.part, range(16) r(t)),
w AS (SELECT k, t, sub, (CASE ib {_WEIGHTS} END)[CAST({_num("i0 + ib * t - before", "ib - anchor")} AS INT) + 1] AS w FROM tx),
px AS (SELECT w.k, w.t, lo.c, ((lo.v * (64 - w) + hi.v * w + 32) // 64) * 31 // 64 AS v FROM w JOIN ew lo ON lo.k = w.k AND lo.n = 2 * w.sub JOIN ew hi ON hi.k = w.k AND hi.c = lo.c AND hi.n = 2 * w.sub + 1)
SELECT k AS p_partkey, CAST(t // 4 AS INT) AS y, CAST(t % 4 AS INT) AS x, CAST(max(v) FILTER (WHERE c = 0) AS INT) AS red, CAST(max(v) FILTER (WHERE c = 1) AS INT) AS green, CAST(max(v) FILTER (WHERE c = 2) AS INT) AS blue
FROM px GROUP BY k, t"""


@query(_BC6H)
def bc6h_all_modes(spark, sf_dir):
    """Blocks of fourteen modes: partitions, deltas and indices, all from digests."""
    k = F.col("p_partkey")
    mode = F.get(F.array(*map(F.lit, BC6H_MODES)), (k % 14).cast("int"))
    element = digest_block(k, F.when(mode < 2, 2).otherwise(5), mode)
    return bc6h.decode_words(read(spark, sf_dir, "part").select("p_partkey", element.alias("element")), "p_partkey", signed=False)
