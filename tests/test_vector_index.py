"""The stored vector index: recall and rows read of the registered setting, exactness with reach 1, pruning."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.operators.vectorindex import VectorIndex
from palimpsest.plans import catalog, tables
from palimpsest.plans.search import asked_vectors, probe_vector

from .conftest import SMALL


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_rows_read(spark, sf_dir):
    asked = asked_vectors(spark, sf_dir)
    exact = {(r["qid"], r["id"]) for r in search.search_batch(tables.chunks(spark, sf_dir), asked, 10).collect()}
    found = catalog.QUERIES["qry03_approximate_neighbours"](spark, sf_dir).collect()
    assert len({r["qid"] for r in found}) == asked.count() and len(found) == len(exact)
    assert len(exact & {(r["qid"], r["id"]) for r in found}) >= 0.9 * len(exact)
    index = tables.vector_index(spark, sf_dir)
    read = index.pairs_read(asked, 10).first()
    print(sf_dir, "recall", len(exact & {(r["qid"], r["id"]) for r in found}) / len(exact), "share", read["compared"] / read["pairs"], "reach", index.reach())
    assert read["compared"] < 0.5 * read["pairs"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Clusters, a zero vector and a hot vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    vectors = [[0.0] * 8, *(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))).tolist(), *[[1.0] + [0.0] * 7] * 300]
    c = spark.createDataFrame([(f"{i:04}", v, "turn" if i % 3 else "summary") for i, v in enumerate(vectors)], "id string, vector array<float>, chunk_type string").cache()
    return c, VectorIndex(spark, str(tmp_path_factory.mktemp("index"))).build(c)


def test_reach_one_is_exact(spark, odd):
    c, index = odd
    asked = c.where("id % 7 = 0").select(F.col("id").cast("long").alias("qid"), "vector")
    ranked = lambda d: sorted((r["qid"], r["distance"], r["id"]) for r in d.collect())
    assert index.rows().count() == c.count()
    found = ranked(index.search(asked, 5, reach=1.0))
    assert found == ranked(search.search_batch(c, asked, 5)) and len(found) == 5 * (asked.count() - 1)  # the zero vector is near nothing
    read = index.pairs_read(asked, 5, reach=1.0).first()
    assert read["compared"] < 0.6 * read["pairs"]  # clusters: even exact bands leave most out


def test_one_query_reads_folders_and_row_groups_only_where_it_must(spark, odd):
    c, index = odd
    query = [float(x) for x in c.where("id = '0030'").first()["vector"]]
    found, reads = index.one(query, 6, reach=1.0, condition=F.col("chunk_type") == "turn")
    exact = search.vector_candidates(c.where("chunk_type = 'turn'"), query, 6)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in exact.collect()]
    assert sum(r.count() for r in reads) < 0.6 * c.count()
    plans = [r._jdf.queryExecution().executedPlan().toString() for r in reads]
    assert all("PartitionFilters: [" in p and "PartitionFilters: []" not in p for p in plans)
    assert all("GreaterThanOrEqual(angle" in p for p in plans[1:])


def test_a_second_search_of_an_index_builds_nothing(spark):
    first, again = tables.vector_index(spark, SMALL), tables.vector_index(spark, SMALL)
    assert first is again and first.exists()
    query = probe_vector(spark, SMALL)
    near = {r["id"] for r in first.one(query, 10)[0].collect()}
    assert len(near & {r["id"] for r in search.vector_candidates(tables.chunks(spark, SMALL), query, 10).collect()}) >= 8


def test_widths_must_agree(spark, tmp_path):
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path)).build(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, vector array<float>"))
