"""Sample types as column expressions: normalised integers, halves, alpha, colour transfer.

Rounding differs by kernel and is part of each contract: normalised integers round half to even, packed pixels
round half up (see packed.py), shared-exponent bytes truncate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unorm_to_float(c: Column, bits: int = 8) -> Column:
    """float32(v) times the float32 reciprocal of the largest value. A product of floats stays float in Spark."""
    return c.cast("float") * (F.lit(1.0).cast("float") / F.lit(float((1 << bits) - 1)).cast("float")).cast("float")


def float_to_unorm(c: Column, bits: int = 8) -> Column:
    """Scaled in float32, rounded half to even, clamped; NaN becomes 0."""
    top = float((1 << bits) - 1)
    scaled = F.nanvl(c.cast("float"), F.lit(0.0).cast("float")) * F.lit(top).cast("float")
    return F.least(F.greatest(F.rint(scaled.cast("double")), F.lit(0.0)), F.lit(top)).cast("int")


def half_to_float(word: Column) -> Column:
    """IEEE half bits (int) to double: subnormals, infinities and NaN included."""
    w = word.cast("int")
    sign = F.when(F.getbit(w, F.lit(15)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(w, 10).bitwiseAND(31)
    mantissa = w.bitwiseAND(1023).cast("double")
    special = F.when(mantissa == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (
        F.when(exponent == 0, sign * mantissa * F.lit(2.0**-24))
        .when(exponent == 31, special)
        .otherwise(sign * (1 + mantissa / 1024) * F.pow(F.lit(2.0), (exponent - 15).cast("double")))
    )


def _power_of_two_below(m: Column) -> Column:
    """floor(log2(m)) for m > 0, exact at powers of two where log2 may fall short or over."""
    e = F.floor(F.log2(m)).cast("int")
    p = F.pow(F.lit(2.0), e.cast("double"))
    return F.when(p > m, e - 1).when(2 * p <= m, e + 1).otherwise(e)


def float_to_half(c: Column) -> Column:
    """IEEE half bits, round to nearest even; overflow gives infinity, NaN a quiet NaN."""
    v = c.cast("double")
    m = F.abs(F.nanvl(v, F.lit(0.0)))
    negative = (v < 0) & ~F.isnan(v)
    e = F.greatest(_power_of_two_below(F.when((m > 0) & (m < 1e300), m).otherwise(F.lit(1.0))), F.lit(-14))
    unit = F.pow(F.lit(2.0), (e - 10).cast("double"))
    steps = F.rint(F.least(m, F.lit(131072.0)) / unit).cast("int")  # a carry into the exponent adds up by itself
    bits = F.when(m == 0, F.lit(0)).when(m >= 65520.0, F.lit(0x7C00)).otherwise(steps + (e + 14) * 1024)
    return F.when(F.isnan(v), F.lit(0x7E00)).otherwise(bits + F.when(negative, F.lit(0x8000)).otherwise(F.lit(0)))


def premultiply(c: Column, alpha: Column) -> Column:
    return c * alpha


def unpremultiply(c: Column, alpha: Column) -> Column:
    return F.when(alpha == 0, F.lit(0.0)).otherwise(F.try_divide(c, alpha))


def linear_to_srgb(c: Column) -> Column:
    """Keeps the sign; linear below 0.0031308."""
    m = F.abs(c)
    curve = F.when(m <= 0.0031308, 12.92 * m).otherwise(1.055 * F.pow(m, F.lit(1 / 2.4)) - 0.055)
    return F.when(c < 0, -curve).otherwise(curve)


def srgb_to_linear(c: Column) -> Column:
    m = F.abs(c)
    curve = F.when(m <= 0.04045, m / 12.92).otherwise(F.pow((m + 0.055) / 1.055, F.lit(2.4)))
    return F.when(c < 0, -curve).otherwise(curve)


def byteswap(c: Column, bits: int) -> Column:
    """The other byte order of an unsigned word."""
    out = F.lit(0).cast("long")
    for k in range(bits // 8):
        byte = F.shiftright(c.cast("long"), 8 * k).bitwiseAND(255)
        out = out + F.shiftleft(byte, bits - 8 - 8 * k)
    return out
