"""Vector functions as columns; all arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def literal(vector: list[float]) -> Column:
    """A query vector as a constant, so that scoring needs no join."""
    return F.array(*(F.lit(float(x)) for x in vector))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero: its norm counts as 1."""
    guard = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (guard(norm(a)) * guard(norm(b)))


def score_of(distance: Column) -> Column:
    """1 / (1 + distance); 0 for a null."""
    return F.coalesce(1.0 / (1.0 + distance), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """The logistic function without overflow."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))
