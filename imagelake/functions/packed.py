"""Packed pixels as column expressions: bit fields, shared exponents, small unsigned floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from imagelake.functions.samples import _power_of_two_below

# Fixed values: (channel, first bit, bits) of each packed format, lowest bit first.
FIELDS = {
    "r10g10b10a2": (("r", 0, 10), ("g", 10, 10), ("b", 20, 10), ("a", 30, 2)),
    "b5g6r5": (("b", 0, 5), ("g", 5, 6), ("r", 11, 5)),
    "b5g5r5a1": (("b", 0, 5), ("g", 5, 5), ("r", 10, 5), ("a", 15, 1)),
    "r11g11b10f": (("r", 0, 11), ("g", 11, 11), ("b", 22, 10)),
    "rgb9e5": (("r", 0, 9), ("g", 9, 9), ("b", 18, 9), ("e", 27, 5)),
}


def field(word: Column, first: int, bits: int) -> Column:
    return F.shiftright(word.cast("long"), first).bitwiseAND((1 << bits) - 1)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def unpack_unorm(word: Column, fmt: str) -> dict[str, Column]:
    """Each field times the reciprocal of its largest value."""
    return {c: field(word, at, n) * F.lit(1.0 / ((1 << n) - 1)) for c, at, n in FIELDS[fmt]}


def pack_unorm(channels: dict[str, Column], fmt: str) -> Column:
    """floor(clamp(v) * max + 0.5): half up; NaN is 0."""
    out = F.lit(0).cast("long")
    for c, at, n in FIELDS[fmt]:
        out = out + F.shiftleft(F.floor(clamp01(channels[c]) * ((1 << n) - 1) + 0.5).cast("long"), at)
    return out


def rgbe_decode(mantissa: Column, exponent: Column) -> Column:
    return F.when(exponent == 0, F.lit(0.0)).otherwise(mantissa.cast("double") * F.pow(F.lit(2.0), (exponent - 136).cast("double")))


def rgbe_encode(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Bytes r, g, b, e. Negatives count as 0; a top that isn't finite or is below 1e-32 gives four zeros; the
    mantissas are truncated."""
    r, g, b = (F.greatest(c.cast("double"), F.lit(0.0)) for c in (r, g, b))
    top = F.greatest(r, g, b)
    zero = F.isnan(top) | (top > 3.5e38) | (top < 1e-32)
    e = F.least(F.greatest(_power_of_two_below(F.when(zero, F.lit(1.0)).otherwise(top)) + 1, F.lit(-128)), F.lit(127))
    scale = F.pow(F.lit(2.0), (8 - e).cast("double"))
    part = lambda c: F.when(zero, F.lit(0)).otherwise(F.least(F.floor(F.when(zero, F.lit(0.0)).otherwise(c) * scale), F.lit(255)).cast("int"))
    return {"r": part(r), "g": part(g), "b": part(b), "e": F.when(zero, F.lit(0)).otherwise(e + 128)}


def rgb9e5_decode(word: Column) -> dict[str, Column]:
    scale = F.pow(F.lit(2.0), (field(word, 27, 5) - 24).cast("double"))
    return {c: field(word, at, n) * scale for c, at, n in FIELDS["rgb9e5"][:3]}


def rgb9e5_encode(r: Column, g: Column, b: Column) -> Column:
    """Clamped to [0, 65408]; the exponent is shared, mantissas are floor(x / scale + 0.5), and a top that rounds
    to 512 takes the next exponent."""
    r, g, b = (F.least(F.greatest(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(65408.0)) for c in (r, g, b))
    top = F.greatest(r, g, b)
    e = F.greatest(_power_of_two_below(F.when(top > 0, top).otherwise(F.lit(2.0**-16))), F.lit(-16)) + 16
    rounds_up = F.floor(top / F.pow(F.lit(2.0), (e - 24).cast("double")) + 0.5) == 512
    e = F.when(rounds_up, e + 1).otherwise(e)
    scale = F.pow(F.lit(2.0), (e - 24).cast("double"))
    part = lambda c, at: F.shiftleft(F.floor(c / scale + 0.5).cast("long"), at)
    return part(r, 0) + part(g, 9) + part(b, 18) + F.shiftleft(e.cast("long"), 27)


def small_float_decode(bits: Column, mantissa_bits: int) -> Column:
    """Unsigned float with 5 exponent bits and 6 or 5 of mantissa."""
    w = bits.cast("long")
    e, m, one = F.shiftright(w, mantissa_bits), w.bitwiseAND((1 << mantissa_bits) - 1).cast("double"), float(1 << mantissa_bits)
    special = F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (
        F.when(e == 0, m * F.lit(2.0**-14 / one))
        .when(e == 31, special)
        .otherwise((1 + m / one) * F.pow(F.lit(2.0), (e - 15).cast("double")))
    )


def small_float_encode(c: Column, mantissa_bits: int) -> Column:
    """Nearest even; zero and below give 0, NaN a quiet NaN, what rounds beyond the largest finite value infinity."""
    v, n = c.cast("double"), mantissa_bits
    one = 1 << n
    m = F.least(F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), F.lit(131072.0))
    e = F.greatest(_power_of_two_below(F.when(m > 0, m).otherwise(F.lit(1.0))), F.lit(-14))
    steps = F.rint(m / F.pow(F.lit(2.0), (e - n).cast("double"))).cast("long")
    bits = F.when(m == 0, F.lit(0).cast("long")).otherwise(steps + (e + 14).cast("long") * one)
    return F.when(F.isnan(v), F.lit((31 << n) | (one >> 1))).otherwise(F.least(bits, F.lit(31 << n)))


def r11g11b10f_decode(word: Column) -> dict[str, Column]:
    return {c: small_float_decode(field(word, at, n), n - 5) for c, at, n in FIELDS["r11g11b10f"]}


def r11g11b10f_encode(r: Column, g: Column, b: Column) -> Column:
    values = {"r": r, "g": g, "b": b}
    out = F.lit(0).cast("long")
    for c, at, n in FIELDS["r11g11b10f"]:
        out = out + F.shiftleft(small_float_encode(values[c], n - 5).cast("long"), at)
    return out
