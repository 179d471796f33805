"""Places in an order, over more rows than a sample of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import rollups


def test_places_are_the_same_in_any_ranges(spark):
    """More rows than Spark samples for the bounds of its ranges."""
    rows = spark.range(80_000).groupBy((F.col("id") % 40_000).alias("user_id")).agg(F.max(F.xxhash64("id")).alias("seen"), F.max_by("id", F.xxhash64("id")).alias("kind"))
    placed = rollups.placed(rows, [F.desc_nulls_last("seen"), "user_id"]).collect()
    assert [r["place"] for r in sorted(placed, key=lambda r: (-r["seen"], r["user_id"]))] == list(range(1, 40_001))
