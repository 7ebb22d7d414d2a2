"""Unsigned 128-bit integers as structs (hi, lo) of bigints; arithmetic modulo 2 ** 128."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

_MIN = -(1 << 63)


def make(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))


def _sum64(a: Column, b: Column, carry: Column) -> tuple[Column, Column]:
    """Sum modulo 2^64 and carry, by halves that cannot overflow."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    low = al + bl + carry
    high = ah + bh + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF))), F.shiftright(high, 32)


def add(a: Column, b: Column) -> Column:
    lo, carry = _sum64(a["lo"], b["lo"], F.lit(0).cast("long"))
    return make(_sum64(a["hi"], b["hi"], carry)[0], lo)


def subtract(a: Column, b: Column) -> Column:
    """a - b = a + ~b + 1."""
    lo, carry = _sum64(a["lo"], F.bitwise_not(b["lo"]), F.lit(1).cast("long"))
    return make(_sum64(a["hi"], F.bitwise_not(b["hi"]), carry)[0], lo)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1, unsigned."""
    flip = lambda c: c.bitwiseXOR(F.lit(_MIN))
    x, y = F.struct(flip(a["hi"]), flip(a["lo"])), F.struct(flip(b["hi"]), flip(b["lo"]))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def bit(a: Column, exponent: int) -> Column:
    return F.shiftrightunsigned(a["hi"] if exponent >= 64 else a["lo"], exponent % 64).bitwiseAND(F.lit(1)) == 1


def set_bit(a: Column, exponent: int) -> Column:
    one = F.lit((1 << (exponent % 64)) if exponent % 64 < 63 else _MIN)
    return make(a["hi"].bitwiseOR(one), a["lo"]) if exponent >= 64 else make(a["hi"], a["lo"].bitwiseOR(one))


def bit_and(a: Column, b: Column) -> Column:
    return make(a["hi"].bitwiseAND(b["hi"]), a["lo"].bitwiseAND(b["lo"]))


def bit_or(a: Column, b: Column) -> Column:
    return make(a["hi"].bitwiseOR(b["hi"]), a["lo"].bitwiseOR(b["lo"]))


def bit_not(a: Column) -> Column:
    return make(F.bitwise_not(a["hi"]), F.bitwise_not(a["lo"]))


def shift_left(a: Column, n: int) -> Column:
    zero = F.lit(0).cast("long")
    if n >= 128:
        return make(zero, zero)
    if n >= 64:
        return make(F.shiftleft(a["lo"], n - 64), zero)
    return a if n == 0 else make(F.shiftleft(a["hi"], n).bitwiseOR(F.shiftrightunsigned(a["lo"], 64 - n)), F.shiftleft(a["lo"], n))


def shift_right(a: Column, n: int) -> Column:
    zero = F.lit(0).cast("long")
    if n >= 128:
        return make(zero, zero)
    if n >= 64:
        return make(zero, F.shiftrightunsigned(a["hi"], n - 64))
    return a if n == 0 else make(F.shiftrightunsigned(a["hi"], n), F.shiftrightunsigned(a["lo"], n).bitwiseOR(F.shiftleft(a["hi"], 64 - n)))
