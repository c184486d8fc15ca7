"""Vectors as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def normalized(v: Column) -> Column:
    """Divided by its norm, or by FLOOR if the norm is less; a zero vector stays zero."""
    return let(doubles(v), lambda a: let(F.greatest(norm(a), F.lit(FLOOR)), lambda n: F.transform(a, lambda x: x / n)))


def renormalized(v: Column) -> Column:
    """Divided by its norm; unchanged if that is below FLOOR."""
    return let(doubles(v), lambda a: let(norm(a), lambda n: F.when(n < FLOOR, a).otherwise(F.transform(a, lambda x: x / n))))


def plus(a: Column, b: Column) -> Column:
    """The sum; a missing vector counts as none."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))


def times(v: Column, k: Column) -> Column:
    return F.transform(v, lambda x: x * k)


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))
