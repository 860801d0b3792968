"""Arithmetic on array<double> vectors, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot, floored at zero; vectors are expected at unit length and are not rescaled."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def rbf(a: Column, b: Column, gamma: Column) -> Column:
    return F.exp(-gamma * squared_distance(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x * x)))


def unit(v: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    # The norm is bound once as the element of a one-element array, else it would be computed for every element.
    scaled = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
    return F.get(scaled, 0)
