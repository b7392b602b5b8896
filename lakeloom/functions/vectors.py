"""Distances between vector columns, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision; null if a component is."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cos) / 2, in [0, 1]: null if a vector or one of its components is, NaN for a zero vector.

    Vectors of different lengths are an error.
    """
    size = norm(a) * norm(b)
    distance = F.when(size == 0, F.lit(float("nan"))).otherwise((1 - F.try_divide(dot(a, b), size)) / 2)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("cosine_distance: vectors have different lengths"))).otherwise(distance)


def array_distance(a: Column, b: Column) -> Column:
    """The Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def vector(values: list[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])
