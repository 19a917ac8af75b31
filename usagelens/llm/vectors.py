"""Vectors as rows and as packed blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components; false for null and empty ones."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def bounded_sample(rows: DataFrame, column: str, limit: int) -> np.ndarray:
    """At most ``limit`` vectors on the driver, those of the smallest hash: the same ones in every run."""
    found = rows.select(column).orderBy(F.xxhash64(column), column).limit(limit).collect()
    return np.array([row[0] for row in found])


def common_length(rows: DataFrame, vector: str) -> int:
    """The commonest length of the vectors, the larger one of a tie; 0 without rows."""
    lengths = rows.groupBy(F.size(vector).alias("length")).count().orderBy(F.col("count").desc(), F.col("length").desc())
    found = lengths.first()
    return found["length"] if found else 0


def matrix(column) -> np.ndarray:
    """A list column of an Arrow batch, lists of one length, as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different points, each the farthest from those before."""
    if not len(points):
        return points
    chosen, distance = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < count and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]
