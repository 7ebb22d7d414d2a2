"""Polynomials as arrays of double coefficients, low degree first."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from rankframe.functions.mathx import EPS_1000


def evaluate(c: Column, x: Column) -> Column:
    return F.aggregate(F.reverse(c), F.lit(0.0), lambda acc, k: acc * x + k)


def add(p: Column, q: Column, factor: float = 1.0) -> Column:
    """p + factor * q."""
    return F.zip_with(p, q, lambda a, b: F.coalesce(a, F.lit(0.0)) + factor * F.coalesce(b, F.lit(0.0)))


def shift(p: Column, exponent: int, factor: float) -> Column:
    """p + factor * x ** exponent."""
    return add(p, F.concat(F.array_repeat(F.lit(0.0), exponent), F.array(F.lit(factor))))


def scale(p: Column, exponent: int, factor: float) -> Column:
    """factor * x ** exponent * p."""
    return F.concat(F.array_repeat(F.lit(0.0), exponent), F.transform(p, lambda c: c * factor))


def multiply(p: Column, q: Column) -> Column:
    n, m = F.size(p), F.size(q)

    def entry(k: Column) -> Column:
        i = F.sequence(F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1))
        return F.aggregate(i, F.lit(0.0), lambda acc, j: acc + F.get(p, j) * F.get(q, k - j))

    return F.transform(F.sequence(F.lit(0), n + m - 2), entry)


def lagrange(which: int, points: list[float]) -> list[float]:
    """Coefficients of the polynomial that is 1 at points[which] and 0 at the others."""
    c = [1.0]
    for j, p in enumerate(points):
        if j != which:
            d = points[which] - p
            c = [(a - p * b) / d for a, b in zip([0.0, *c], [*c, 0.0], strict=True)]
    return c


def roots(p: Column) -> Column:
    """Real roots up to degree two, ascending; coefficients and discriminants within 1000 eps of 0 count as 0."""
    c0, c1, c2 = (F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i in range(3))
    half, prod = -0.5 * c1 / c2, c0 / c2
    disc = half * half - prod
    far = F.when(half >= 0, half + F.sqrt(disc)).otherwise(half - F.sqrt(disc))
    none = F.array().cast("array<double>")
    quadratic = F.when(disc <= -EPS_1000, none).when(disc < EPS_1000, F.array(half)).otherwise(F.array_sort(F.array(far, prod / far)))
    linear = F.when(F.abs(c1) < EPS_1000, none).otherwise(F.array(-c0 / c1))
    return F.when(F.abs(c2) < EPS_1000, linear).otherwise(quadratic)
