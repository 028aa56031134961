"""Rows with usable vectors, as double arrays of one length, and the range of their scaled components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def kept(vectors: DataFrame, length: int, *more: str) -> DataFrame:
    """``vec_id``, the columns of ``more`` and the vector ``_v`` as doubles, of the rows whose vector is finite and has ``length`` components."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *more, F.col("embedding").cast("array<double>").alias("_v")).where((F.size("_v") == length) & finite(F.col("_v")))


def scaled_range(rows: DataFrame, scale: int) -> tuple[int, int] | None:
    """The least and the greatest ``floor(scale * x)``; None without rows."""
    low, high = rows.agg(F.min(F.array_min("_v")), F.max(F.array_max("_v"))).first()
    return None if low is None else (math.floor(scale * low), math.floor(scale * high))


def integers(column: pa.Array, scale: int, length: int) -> np.ndarray:
    """``floor(scale * x)`` of the vectors of a batch, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(values * scale).astype(np.int64).reshape(len(column), length)


def floors(total: list[int], n: int) -> list[int]:
    """Exact ``floor(sum / count)`` by component."""
    return [int(x) // int(n) for x in total]


def sums_by(groups: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by group number below ``size``."""
    out = np.zeros((size, values.shape[1]), np.int64)
    if len(groups):
        order = np.argsort(groups, kind="stable")
        own, first = np.unique(groups[order], return_index=True)
        out[own] = np.add.reduceat(values[order], first, axis=0)
    return out
