"""Vectors as exact integers: which rows count, and Arrow lists as numpy matrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import col


def finite(vector: Column) -> Column:
    """True where the vector is neither null nor holds null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def numbered(df: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """id, vector (and ``others`` as o0, o1, ...) of the rows that count."""
    rows = df.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("vector"), *[col(c).alias(f"o{i}") for i, c in enumerate(others)])
    return rows.where(finite(F.col("vector")))


def width_of(rows: DataFrame) -> int:
    """The length of the longest vector; 0 if there is none."""
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def whole_numbers(vectors: pa.Array, width: int, factor: int, limit: int) -> np.ndarray:
    """floor(factor * x) of every component, at most ``limit`` in magnitude; short vectors end in zeros."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    flat = np.floor(np.asarray(vectors.flatten(), np.float64) * factor)
    flat = np.clip(flat, -limit, limit).astype(np.int64)
    n = len(vectors)
    if len(flat) == n * width:
        return flat.reshape(n, width)
    sizes = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((n, width), np.int64)
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def product_limit(width: int) -> int:
    """Components up to this magnitude have inner products that fit in a long."""
    return min(math.isqrt((2**63 - 1) // max(width, 1)), 2**31 - 1)


def distance_limit(width: int) -> int:
    """Components up to this magnitude have squared distances that fit in a long."""
    return min(math.isqrt((2**63 - 1) // max(width, 1)) // 2, 2**30)
