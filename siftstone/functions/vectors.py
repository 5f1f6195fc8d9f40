"""Vector functions as Columns of doubles over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def vector_literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is null, empty or zero, or if lengths differ."""
    fine = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fine, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of vectors of the same length."""
    return F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))
