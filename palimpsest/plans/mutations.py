"""Writes to the chunk table, told as the table after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import store
from ..operators.mergetable import MergeTable
from ..paths import scratch
from . import tables
from .registry import query

C = tables.CHUNKS_SQL
_SEEN = "id, session_id, machine_id, length(content) AS n_chars"


def _seen(df):
    return df.select("id", "session_id", "machine_id", F.length("content").cast("long").alias("n_chars"))


def _batch(spark, sf_dir):
    """Changed copies of every tenth chunk, twice, and some new chunks."""
    c = tables.chunks(spark, sf_dir).where("doc_id % 10 = 0")
    once = c.withColumn("content", F.concat(F.lit("v1 "), "content")).withColumn("seq", F.lit(1))
    twice = c.where("doc_id % 20 = 0").withColumn("content", F.concat(F.lit("v2! "), "content")).withColumn("seq", F.lit(2))
    fresh = c.where("doc_id % 50 = 0").withColumn("id", F.concat(F.lit("new"), "id")).withColumn("seq", F.lit(1))
    return once.unionByName(twice).unionByName(fresh)


@query("snk02_upsert", f"""WITH {C}, b AS (SELECT * REPLACE ('v1 ' || content AS content), 1 AS seq FROM chunks WHERE doc_id % 10 = 0 UNION ALL BY NAME
SELECT * REPLACE ('v2! ' || content AS content), 2 AS seq FROM chunks WHERE doc_id % 20 = 0 UNION ALL BY NAME SELECT * REPLACE ('new' || id AS id), 1 AS seq FROM chunks WHERE doc_id % 50 = 0),
a AS (SELECT *, 0 AS seq FROM chunks UNION ALL BY NAME SELECT * FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth FROM a) SELECT {_SEEN} FROM r WHERE nth = 1""")
def snk02(spark, sf_dir):
    return _seen(store.upsert(tables.chunks(spark, sf_dir), _batch(spark, sf_dir)))


@query("snk02_stm04_merged_on_read", f"""WITH {C}, b AS (SELECT * REPLACE ('v1 ' || content AS content), 1 AS seq FROM chunks WHERE doc_id % 10 = 0 UNION ALL BY NAME
SELECT * REPLACE ('v2! ' || content AS content), 2 AS seq FROM chunks WHERE doc_id % 20 = 0 UNION ALL BY NAME SELECT * REPLACE ('new' || id AS id), 1 AS seq FROM chunks WHERE doc_id % 50 = 0),
a AS (SELECT *, 0 AS seq FROM chunks UNION ALL BY NAME SELECT * FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth FROM a) SELECT {_SEEN} FROM r WHERE nth = 1 AND (id LIKE 'new%' OR doc_id % 30 <> 10)""")
def snk02_merged(spark, sf_dir):
    """Three writes, the second of which is sent again, and deletes: read as deltas over a merged table."""
    held, c = MergeTable(spark, scratch(spark, "merged-on-read"), cluster=("project_name", "timestamp")), tables.chunks(spark, sf_dir)
    held.upsert(c.withColumn("seq", F.lit(0)), number=0)
    held.merge()
    for number in (1, 1):
        held.upsert(_batch(spark, sf_dir), number=number)
    held.delete(c.where("doc_id % 30 = 10").select("id"))
    return _seen(held.read())


@query("snk03_insert_without_vector", f"WITH {C} SELECT id, vector IS NULL AS awaiting FROM chunks UNION ALL SELECT 'later' || id, true FROM chunks WHERE doc_id % 7 = 0")
def snk03(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    later = c.where("doc_id % 7 = 0").select(F.concat(F.lit("later"), "id").alias("id"), F.lit(None).cast("array<float>").alias("vector"))
    return c.select("id", "vector").unionByName(later).select("id", F.col("vector").isNull().alias("awaiting"))


@query("snk05_snk06_backfill", f"WITH {C} SELECT id, true AS embedded FROM chunks")
def snk05(spark, sf_dir):
    filled = store.backfill(tables.chunks(spark, sf_dir).select("id", "content", "vector"), store.hashed_vectors(64), shards=16)
    return filled.select("id", F.col("vector").isNotNull().alias("embedded"))


@query("snk04_emb01_embedding", f"WITH {C} SELECT id, 64 AS n FROM chunks WHERE trim(content) <> '' AND vector IS NULL")
def snk04(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).where("vector IS NULL").select("id", "content")
    done = c.mapInPandas(store.embed_batches(store.hashed_vectors(64), clean=tx.clean_for_embedding), "id string, vector array<float>")
    return done.select("id", F.size("vector").alias("n"))


@query("snk07_qry18_delete_machine", f"WITH {C} SELECT {_SEEN} FROM chunks WHERE machine_id <> 'machine-1'")
def snk07(spark, sf_dir):
    return _seen(store.without_machine(tables.chunks(spark, sf_dir), "machine-1")[0])


@query("snk07_deleted_count", f"WITH {C} SELECT count(*) AS deleted FROM chunks WHERE machine_id = 'machine-1'")
def snk07_count(spark, sf_dir):
    return store.without_machine(tables.chunks(spark, sf_dir), "machine-1")[1]


@query("snk08_clear", f"WITH {C} SELECT count(*) AS before, 0::BIGINT AS after FROM chunks")
def snk08(spark, sf_dir):
    return tables.chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("before"), F.lit(0).cast("long").alias("after"))


@query("src19_waiting", f"WITH {C} SELECT id FROM chunks WHERE vector IS NULL AND starts_with(id, 'a') ORDER BY id LIMIT 25")
def src19(spark, sf_dir):
    return store.waiting(tables.chunks(spark, sf_dir), "a", 25).select("id")


@query("agg01_agg02_qry16_statistics", f"WITH {C} SELECT count(*) AS total, count(vector) AS embedded, greatest(count(*) - count(vector), 0) AS awaiting FROM chunks")
def agg02(spark, sf_dir):
    return store.statistics(tables.chunks(spark, sf_dir))


@query("flt13_upload_validation", f"""WITH {C}, u AS (SELECT id, doc_id, CASE WHEN doc_id % 5 <> 0 THEN content END AS content, chunk_type, CASE WHEN doc_id % 7 = 0 THEN '' ELSE session_id END AS session_id,
CASE WHEN doc_id % 11 = 0 THEN -1 ELSE source_line END AS source_line FROM chunks)
SELECT id, CASE WHEN coalesce(content, '') = '' THEN 'content is required' WHEN session_id = '' THEN 'session_id is required' WHEN source_line < 0 THEN 'source_line must be a non-negative integer' END AS reason FROM u""")
def flt13(spark, sf_dir):
    d = F.col("doc_id")
    u = tables.chunks(spark, sf_dir).withColumns({"content": F.when(d % 5 != 0, F.col("content")), "session_id": F.when(d % 7 == 0, "").otherwise(F.col("session_id")), "source_line": F.when(d % 11 == 0, -1).otherwise(F.col("source_line"))})
    return u.select("id", store.rejected(u).alias("reason"))


@query("prj17_prj18_jon12_arr02_scoped_ids", f"""WITH {C} SELECT sha256('m1' || chr(0) || id) AS id, 'm1' AS machine_id, sha256('m1' || chr(0) || 'p' || doc_id) AS parent_chunk_id,
array_to_string(list_transform(['k' || doc_id, 'j' || doc_id], lambda c: sha256('m1' || chr(0) || c)), ',') AS children FROM chunks""")
def prj17(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    c = tables.chunks(spark, sf_dir).select("id", F.concat(F.lit("p"), n).alias("parent_chunk_id"), F.array(F.concat(F.lit("k"), n), F.concat(F.lit("j"), n)).alias("child_chunk_ids"))
    return store.scope_ids(c, "m1").select("id", "machine_id", "parent_chunk_id", F.array_join("child_chunk_ids", ",").alias("children"))


@query("flt15_blank_chunks_skipped", f"WITH {C} SELECT count(*) AS n FROM chunks WHERE trim(content) <> ''")
def flt15(spark, sf_dir):
    return tables.chunks(spark, sf_dir).where(F.trim("content") != "").agg(F.count(F.lit(1)).alias("n"))


@query("prj20_result_shape", f"WITH {C} SELECT id, chunk_type, session_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp, machine_id FROM chunks")
def prj20(spark, sf_dir):
    return tables.chunks(spark, sf_dir).select("id", "chunk_type", "session_id", F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("timestamp"), "machine_id")


@query("arr03_rows_of_structs", f"WITH {C} SELECT id, session_id FROM chunks")
def arr03(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    rows = c.groupBy("source_file").agg(F.collect_list(F.struct("id", "session_id")).alias("rows"))
    return rows.select(F.inline("rows"))


@query("agg19_table_extent", f"WITH {C} SELECT count(DISTINCT session_id) AS conversations, count(DISTINCT project_name) AS projects, CAST(min(timestamp) AS VARCHAR) AS oldest, CAST(max(timestamp) AS VARCHAR) AS newest FROM chunks")
def agg19(spark, sf_dir):
    return tables.chunks(spark, sf_dir).agg(F.count_distinct("session_id").alias("conversations"), F.count_distinct("project_name").alias("projects"), F.min("timestamp").cast("string").alias("oldest"), F.max("timestamp").cast("string").alias("newest"))
