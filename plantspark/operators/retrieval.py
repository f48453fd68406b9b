"""Cosine search over stored vectors.

The query is one vector, a literal of the plan; each task keeps its own top k, so only k rows
per task move. Zero and null vectors have no distance and come last; ties go by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null if either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def search(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows with their distance; 1 to 50 of them."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.withColumn("distance", cosine_distance(F.col(vector), q)).where("distance is not null")
    # Rounded only after the order is taken.
    return rows.orderBy("distance", key).limit(max(1, min(50, k))).withColumn("distance", F.round("distance", 6)).drop(vector)


def vector_of(vectors: DataFrame, key_value: int, key: str = "vec_id", vector: str = "embedding") -> list[float]:
    """One stored vector; empty if it isn't there."""
    row = vectors.where(F.col(key) == key_value).select(vector).first()
    return list(row[0]) if row else []
