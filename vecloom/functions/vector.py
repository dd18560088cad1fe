"""Expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def ieee_divide(x: Column, y: Column) -> Column:
    """x / y with infinities and NaN as in floating point; Spark alone raises or gives null."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(x / y)


def ieee_power(x: Column, y: Column) -> Column:
    """x to the power y; 1 to any power and anything to the power 0 are 1."""
    return F.when((x == 1) | (y == 0), F.lit(1.0)).otherwise(F.pow(x, y))


def _scaled(parts: Column) -> Column:
    """Root of the sum of squares, by way of the largest: no overflow or underflow on the way."""

    def root(p: Column) -> Column:
        def by(most: Column) -> Column:
            size = most * F.sqrt(F.aggregate(p, F.lit(0.0), lambda s, d: s + (d / most) * (d / most)))
            return F.when(most == 0, F.lit(0.0)).when(most == float("inf"), most).otherwise(size)

        return let(F.aggregate(p, F.lit(0.0), lambda m, d: F.greatest(m, F.abs(d))), by)

    return let(parts, root)


def norm(v: Column) -> Column:
    return _scaled(v)


def euclidean(a: Column, b: Column) -> Column:
    """Distance from direct differences, safe at any scale."""
    return _scaled(F.zip_with(a, b, lambda x, y: x - y))


def unit(v: Column) -> Column:
    """v over its length, scaled by its largest entry first."""

    def small(most: Column) -> Column:
        return let(F.transform(v, lambda x: x / most), lambda s: let(F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x)), lambda size: F.transform(s, lambda x: x / size)))

    return let(F.array_max(F.transform(v, lambda x: F.abs(x))), lambda most: F.when(most > 0, small(most)))


def cosine_distance(unit_a: Column, unit_b: Column) -> Column:
    """1 less the cosine of two unit vectors, between 0 and 2."""
    return F.least(F.greatest(1 - dot(unit_a, unit_b), F.lit(0.0)), F.lit(2.0))
