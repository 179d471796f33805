"""One query of a vector index with many cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.operators.vectorindex import GROUPS, VectorIndex


def test_one_query_of_an_index_with_many_cells(spark, tmp_path):
    """The filter of the scan has a bounded number of conditions, whatever the number of cells."""
    vectors = np.random.default_rng(3).normal(size=(500, 6)).tolist()
    c = spark.createDataFrame([(f"{i:04}", v, "turn" if i % 3 else "summary") for i, v in enumerate(vectors)], "id string, vector array<float>, chunk_type string").coalesce(1)
    index = VectorIndex(spark, str(tmp_path)).build(c, cells=120)
    found, reads = index.one(vectors[7], 9, reach=1.0, condition=F.col("chunk_type") == "turn")
    exact = search.vector_candidates(c.where("chunk_type = 'turn'"), vectors[7], 9)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in exact.collect()]
    assert reads[1]._jdf.queryExecution().analyzed().toString().count(" OR ") < GROUPS
