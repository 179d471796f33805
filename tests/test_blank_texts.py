"""Chunks whose text is blank or missing get a vector like all others."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import store
from palimpsest.plans import catalog

from .conftest import SMALL
from .test_oracles import rows_of


@pytest.fixture(scope="module")
def blanks(spark, tmp_path_factory):
    """The smallest tables; of 40 documents in a row, most of them without an embedding, the texts are blank or null."""
    folder = tmp_path_factory.mktemp("blanks")
    documents, embeddings = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "embeddings"))
    nth = F.col("doc_id") % 4
    blank = F.when(nth == 0, "").when(nth == 1, " ").when(nth == 2, "\n\t ")
    documents.withColumn("text", F.when(F.col("doc_id") >= 60, F.col("text")).when(F.col("doc_id") < 20, F.col("text")).otherwise(blank)).write.parquet(f"{folder}/documents.parquet")
    embeddings.where("vec_id % 5 = 0").write.parquet(f"{folder}/embeddings.parquet")
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for t in ("documents", "embeddings"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return str(folder), connection


def agrees(spark, blanks, name):
    folder, connection = blanks
    found, said = catalog.QUERIES[name](spark, folder), connection.sql(catalog.ORACLES[name])
    names = sorted(found.columns)
    assert rows_of(names, found.columns, found.collect()) == rows_of(names, said.columns, said.fetchall())


def test_backfill(spark, blanks):
    agrees(spark, blanks, "snk05_snk06_backfill")


def test_a_model_that_refuses_blank_texts_leaves_them_alone(spark):
    def embed(texts):
        if not all(t.strip() for t in texts):
            raise ValueError("blank")
        return [[float(len(t))] for t in texts]

    table = spark.createDataFrame([("aa", "x", None, 1), ("aa", "xy", None, 2), (None, "xyz", None, 3), ("ab", " ", None, 4), ("ac", None, None, 5), ("ad", "x", [9.0], 6)], "id string, content string, vector array<float>, n int")
    run = store.fill_batches(embed, retries=0, wait=0)
    done = table.where("vector IS NULL").mapInArrow(run, table.schema).collect()
    assert {r["n"]: r["vector"] for r in done} == {1: [1.0], 2: [2.0], 3: [3.0], 4: None, 5: None}
    assert {r["n"]: r["vector"] and len(r["vector"]) for r in store.backfill(table, store.hashed_vectors(4), 2).collect()} == dict.fromkeys(range(1, 6), 4) | {6: 1}


def test_periodic_jobs(spark, blanks):
    agrees(spark, blanks, "stm15_stm16_periodic_jobs")
