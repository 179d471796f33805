"""Vector expressions in double precision: distance and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine similarity with a fixed query; null for null vectors, other lengths or zero vectors."""
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    q = F.array(*[F.lit(float(x)) for x in query])
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    usable = (F.size(vector) == len(query)) & (own > 0) & F.lit(norm > 0)
    return F.when(usable, F.lit(1.0) - dot(vector, q) / (own * F.lit(norm)))


def is_valid(vector: Column, length: int | None = None) -> Column:
    """Not empty, of the length asked for, finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: F.abs(x) >= 1e-10)
    right = F.size(vector) == length if length else F.size(vector) > 0
    return F.coalesce(right & finite & some, F.lit(False))


def index_partitions(rows: Column) -> Column:
    """Cells of a vector index: the root of the rows, between 64 and 2048, never more than rows."""
    root = F.floor(F.sqrt(rows.cast("double"))).cast("long")
    return F.least(F.greatest(F.least(root, F.lit(2048)), F.lit(64)), rows)
