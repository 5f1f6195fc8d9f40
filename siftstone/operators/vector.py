"""Vector candidates: exact nearest neighbours by L2, and a scan for positive cosines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.vectors import cosine, l2, vector_literal


def neighbours_wanted(limit: int) -> int:
    """Neighbours fetched before filters: twenty a result, 100 at least and 500 at most."""
    return min(500, max(100, 20 * limit))


def knn_l2(vectors: DataFrame, query: list[float], k: int, order: list[str], column: str = "embedding") -> DataFrame:
    """The k nearest rows of all vectors of the query's dimension, with distance and similarity; a per-task top-k, then a merge."""
    q = vector_literal(query)
    near = vectors.where(F.size(column) == len(query)).withColumn("distance", l2(F.col(column), q))
    best = near.orderBy("distance", *order).limit(k)
    return best.withColumn("similarity", cosine(F.col(column), q))


def cosine_scan(vectors: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """All rows of positive cosine, with similarity."""
    return vectors.where(F.col(column).isNotNull()).withColumn("similarity", cosine(F.col(column), vector_literal(query))).where("similarity > 0")
