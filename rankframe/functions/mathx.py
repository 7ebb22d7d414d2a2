"""Integer and floating-point functions on columns; all native expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def intpow(base: Column, exp: Column) -> Column:
    """base ** exp for exp >= 0 as bigint; 0 ** 0 is 1, overflow is null."""
    one = F.lit(1).cast("long")
    steps = F.when(exp > 0, F.sequence(F.lit(1), exp.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, one, lambda acc, _: F.try_multiply(acc, base.cast("long")))


def floatpow(base: Column, exp: Column) -> Column:
    """base ** exp for integers exp >= 0 as double, by squaring, so that each product is rounded once."""
    start = F.struct(F.lit(1.0).alias("r"), base.cast("double").alias("b"), exp.cast("long").alias("e"))

    def step(s: Column, _: Column) -> Column:
        odd = s["e"].bitwiseAND(F.lit(1)) == 1
        return F.struct(F.when(odd, s["r"] * s["b"]).otherwise(s["r"]).alias("r"), (s["b"] * s["b"]).alias("b"), F.shiftright(s["e"], 1).alias("e"))

    rounds = F.when(exp > 0, F.sequence(F.lit(1), F.length(F.bin(exp.cast("long"))))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, step)["r"]


def field_sum(*fields: Column) -> Column:
    """Fields combined by adding."""
    out = fields[0]
    for f in fields[1:]:
        out = out + f
    return out


def field_product(*fields: Column) -> Column:
    """Fields combined by multiplying; a constant is a field."""
    out = fields[0]
    for f in fields[1:]:
        out = out * f
    return out


def log2_floor(x: Column) -> Column:
    """floor(log2 x) for x > 0, -1 for 0, exactly."""
    return F.when(x == 0, F.lit(-1)).when(x > 0, F.length(F.bin(x.cast("long"))) - 1).cast("int")


def roundup2(x: Column) -> Column:
    """The least power of two >= x; 0 for x <= 0, null where a bigint cannot hold it."""
    x = x.cast("long")
    width = F.length(F.bin(x - 1))
    up = F.when(x == 1, F.lit(1).cast("long")).when(width < 63, F.call_function("shiftleft", F.lit(1).cast("long"), width))
    return F.when(x <= 0, F.lit(0).cast("long")).when(x > 0, up)


def align_up(x: Column, n: int) -> Column:
    """x rounded up to a multiple of n, for x >= 0, in integers; null where a bigint cannot hold it."""
    x = x.cast("long")
    return F.try_add(x, F.pmod(-x, F.lit(n).cast("long")))


def parse_int(s: Column, bits: int = 32) -> Column:
    """Leading integer of a string in base 10, saturating; 0 without digits."""
    text = F.regexp_extract(s, r"^[ \t\n\r\x0B\f]*([+-]?)0*([0-9]*)", 2)
    minus = F.regexp_extract(s, r"^[ \t\n\r\x0B\f]*([+-]?)", 1) == "-"
    hi, lo = (1 << (bits - 1)) - 1, -(1 << (bits - 1))
    number = F.when(text == "", F.lit(0)).when(F.length(text) <= 19, text.cast("decimal(38,0)")).otherwise(F.lit("1" + "0" * 20).cast("decimal(38,0)"))
    signed = F.when(minus, -number.cast("decimal(38,0)")).otherwise(number.cast("decimal(38,0)"))
    return F.greatest(F.least(signed, F.lit(hi).cast("decimal(38,0)")), F.lit(lo).cast("decimal(38,0)")).cast("int" if bits == 32 else "long")


def search_bias(maxlevel: int, level: Column, interval: Column, target: Column) -> Column:
    """The position below node (level, interval) of a binary tree over 2 ** maxlevel leaves that is nearest to target's.

    Inside the node it is target; a target left of it gives its first leaf, one right of it the last.
    """
    width = F.pow(F.lit(2), F.lit(maxlevel) - level).cast("long")
    left = interval.cast("long") * width
    return F.least(F.greatest(target.cast("long"), left), left + width - 1)


def invert(fn: Callable[[Column], Column], low: float, high: float, y: Column, rtol: float, steps: int = 100) -> Column:
    """x in [low, high] with fn(x) = y to rtol of the range, by false position; fn is monotone there. Null if not found."""
    flo, fhi = fn(F.lit(float(low))), fn(F.lit(float(high)))
    tol = F.abs(fhi - flo) * rtol
    start = F.struct(F.lit(float(low)).alias("a"), F.lit(float(high)).alias("b"), flo.alias("fa"), fhi.alias("fb"), F.lit(None).cast("double").alias("x"))

    def step(s: Column, _: Column) -> Column:
        x = s["a"] + (y - s["fa"]) * (s["b"] - s["a"]) / (s["fb"] - s["fa"])
        f = fn(x)
        right = (f < y) == (fhi > flo)
        moved = F.struct(
            F.when(right, x).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(x).alias("b"),
            F.when(right, f).otherwise(s["fa"]).alias("fa"), F.when(right, s["fb"]).otherwise(f).alias("fb"),
            F.when(F.abs(f - y) <= tol, x).alias("x"),
        )
        return F.when(s["x"].isNotNull(), s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["x"]


EPS_1000 = 1000 * math.ulp(1.0)
