"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def normalize(v: Column) -> Column:
    """Length 1, unless the vector is zero or within 1e-6 of length 1 already."""
    norm = F.sqrt(dot(v, v))
    wide = v.cast("array<double>")
    return F.when((norm == 0) | (F.abs(norm - 1) <= 1e-6), wide).otherwise(F.transform(wide, lambda x: x / norm))


def score_of_distance(squared: Column) -> Column:
    """The cosine of unit vectors from their squared distance."""
    return 1 - squared / 2
