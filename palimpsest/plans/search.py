"""Search queries over the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, vectors
from ..operators import search
from . import tables
from .registry import query

QUESTION = "the queion therand para und"
PROBE = 7
C = tables.CHUNKS_SQL
_Q = f"qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {PROBE})"
_DIST = "round(CASE WHEN sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))) > 0 THEN 1 - list_dot_product(vector::DOUBLE[], q) / (sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))) END, 9)"
_COLUMNS = "id, chunk_type, session_id, project_path, project_name, timestamp, file_path, operation, machine_id, score"


def probe_vector(spark, sf_dir) -> list[float]:
    row = tables.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == PROBE).select("embedding").first()
    return [float(x) for x in row[0]]


def shown(results):
    """The result columns but for the content, of which the length stays."""
    return results.select("id", "chunk_type", "session_id", "project_path", "project_name", "timestamp", "file_path", "operation", "machine_id", F.round("score", 9).alias("score"))


def _near_sql(where: str, limit: int) -> str:
    return f"SELECT id, {_DIST} AS distance FROM chunks, qv WHERE vector IS NOT NULL AND {where} ORDER BY 2, 1 LIMIT {limit}"


def _terms(question: str) -> list[str]:
    return sorted(set(question.lower().split()))


def _bm25_sql(question: str, where: str, limit: int) -> str:
    terms = _terms(question)
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (docs - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * {fixed.BM25_K1 + 1} / (tf{i} + {fixed.BM25_K1} * (1 - {fixed.BM25_B} + {fixed.BM25_B} * n / mean))" for i in range(len(terms)))
    some = " + ".join(f"tf{i}" for i in range(len(terms)))
    return (
        f"SELECT id, round(0.0 + {score}, 9) AS relevance FROM (SELECT id, len(w) AS n, {tf} FROM (SELECT id, regexp_extract_all(lower(content), '[\\pL\\pN_]+') AS w FROM chunks WHERE {where})) a, "
        f"(SELECT count(*) AS docs, avg(n) AS mean, {stats} FROM (SELECT len(w) AS n, {tf} FROM (SELECT regexp_extract_all(lower(content), '[\\pL\\pN_]+') AS w FROM chunks WHERE {where}))) s WHERE {some} > 0 ORDER BY 2 DESC, 1 LIMIT {limit}"
    )


def _fused_sql(where: str = "true", pool: int = 100) -> str:
    return f"""v AS ({_near_sql(where, pool)}), t AS ({_bm25_sql(QUESTION, where, pool)}),
ranks AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY distance, id)) AS part FROM v UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY relevance DESC, id)) FROM t),
fused AS (SELECT id, round(1 - least(1.0, sum(part) / (2.0::DOUBLE / 61)), 9) AS score FROM ranks GROUP BY id)"""


HYBRID_SQL = f"{C}, {_Q}, {_fused_sql()}, best AS (SELECT * FROM fused ORDER BY score, id LIMIT 10), results AS (SELECT c.*, b.score FROM chunks c JOIN best b USING (id))"


def hybrid(spark, sf_dir):
    return search.hybrid_search(tables.chunks(spark, sf_dir), QUESTION, probe_vector(spark, sf_dir), 10, index=tables.text_index(spark, sf_dir))


@query("qry05_hybrid_search", f"WITH {HYBRID_SQL} SELECT {_COLUMNS} FROM results")
def qry05(spark, sf_dir):
    return shown(hybrid(spark, sf_dir))


_WHERE = "project_name = 'src3' AND timestamp >= TIMESTAMP '2026-01-01 01:00:00' AND timestamp <= TIMESTAMP '2026-01-01 15:00:00'"


@query("qry06_qry12_filtered_hybrid", f"WITH {C}, {_Q}, {_fused_sql(_WHERE)}, best AS (SELECT * FROM fused ORDER BY score, id LIMIT 10) SELECT {_COLUMNS} FROM chunks JOIN best USING (id)")
def qry06(spark, sf_dir):
    wanted = search.Filters(project_name="src3", date_from="2026-01-01 01:00:00", date_to="2026-01-01 15:00:00")
    return shown(search.hybrid_search(tables.chunks(spark, sf_dir), QUESTION, probe_vector(spark, sf_dir), 10, wanted, index=tables.text_index(spark, sf_dir)))


def _vector(name: str, where: str, filters: search.Filters, limit: int = 10):
    @query(name, f"WITH {C}, {_Q}, n AS ({_near_sql(where, limit)}) SELECT {_COLUMNS} FROM (SELECT c.*, n.distance AS score FROM chunks c JOIN n USING (id))")
    def run(spark, sf_dir):
        return shown(search.vector_search(tables.chunks(spark, sf_dir), probe_vector(spark, sf_dir), limit, filters))


_vector("qry01_exact_knn", "true", search.Filters())
_vector("qry02_knn_of_project", "project_path = '/work/src1'", search.Filters(project_path="/work/src1"), 20)
_vector("qry07_file_changes", "chunk_type = 'file_change' AND contains(file_path, 'file_3')", search.Filters(chunk_type="file_change", file_path="file_3"))
_vector("qry08_file_changes_by_operation", "chunk_type = 'file_change' AND operation = 'edit'", search.Filters(chunk_type="file_change", operation="edit"), 50)
_vector("flt08_all_filters", "project_path = '/work/src5' AND chunk_type = 'turn' AND timestamp >= TIMESTAMP '2026-01-01 00:10:00'", search.Filters(project_path="/work/src5", chunk_type="turn", date_from="2026-01-01 00:10:00"), 30)


@query("qry04_text_search", f"WITH {C}, t AS ({_bm25_sql(QUESTION, 'true', 20)}) SELECT id, session_id, round(relevance, 7) AS relevance FROM chunks JOIN t USING (id)")
def qry04(spark, sf_dir):
    return search.text_search(tables.chunks(spark, sf_dir), QUESTION, 20, index=tables.text_index(spark, sf_dir)).select("id", "session_id", F.round("relevance", 7).alias("relevance"))


@query("qry10_summaries_once_a_session", f"WITH {C}, {_Q}, n AS ({_near_sql(chr(39).join(['chunk_type = ', 'summary', '']), 30)}) SELECT id, session_id, score FROM (SELECT c.id, session_id, n.distance AS score, row_number() OVER (PARTITION BY session_id ORDER BY n.distance, c.id) AS nth FROM chunks c JOIN n USING (id)) WHERE nth = 1 ORDER BY score, id LIMIT 10")
def qry10(spark, sf_dir):
    return search.session_summaries(tables.chunks(spark, sf_dir), probe_vector(spark, sf_dir), 10, once_a_session=True).select("id", "session_id", "score")


@query("qry09_flt16_top05_summaries_of_session", f"WITH {C}, {_Q}, n AS ({_near_sql(chr(39).join(['chunk_type = ', 'summary', '']), 250)}) SELECT c.id, session_id, n.distance AS score FROM chunks c JOIN n USING (id) WHERE session_id = 's7' ORDER BY 3, 1 LIMIT 5")
def qry09(spark, sf_dir):
    return search.session_summaries(tables.chunks(spark, sf_dir), probe_vector(spark, sf_dir), 5, session="s7").select("id", "session_id", "score")


@query("top01_win01_ranked_neighbours", f"WITH {C}, {_Q}, n AS ({_near_sql('true', 100)}) SELECT id, distance, row_number() OVER (ORDER BY distance, id) - 1 AS rank FROM n")
def top01(spark, sf_dir):
    near = search.vector_candidates(tables.chunks(spark, sf_dir), probe_vector(spark, sf_dir), fixed.CANDIDATE_POOL)
    return near.selectExpr("id", "distance", "cast(row_number() OVER (ORDER BY distance, id) - 1 AS bigint) AS rank")  # at most CANDIDATE_POOL rows


@query("top02_text_ranks", f"WITH {C}, t AS ({_bm25_sql(QUESTION, 'true', 100)}) SELECT id, row_number() OVER (ORDER BY relevance DESC, id) - 1 AS rank FROM t")
def top02(spark, sf_dir):
    best = search.text_candidates(tables.chunks(spark, sf_dir), QUESTION, fixed.CANDIDATE_POOL, index=tables.text_index(spark, sf_dir))
    return best.selectExpr("id", "cast(row_number() OVER (ORDER BY relevance DESC, id) - 1 AS bigint) AS rank")


@query("agg03_set01_mth03_fusion", f"WITH {C}, {_Q}, {_fused_sql()} SELECT id, score FROM fused")
def agg03(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    return search.fused(search.vector_candidates(c, probe_vector(spark, sf_dir), 100), search.text_candidates(c, QUESTION, 100, index=tables.text_index(spark, sf_dir)))


@query("top03_top04_best_fused", f"WITH {C}, {_Q}, {_fused_sql(pool=200)} SELECT id, score FROM fused ORDER BY score, id LIMIT 40")
def top03(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    return search.fused(search.vector_candidates(c, probe_vector(spark, sf_dir), 200), search.text_candidates(c, QUESTION, 200, index=tables.text_index(spark, sf_dir))).orderBy("score", "id").limit(40)


@query("mth01_cosine_distances", f"WITH {C}, {_Q} SELECT id, {_DIST} AS distance FROM chunks, qv WHERE vector IS NOT NULL")
def mth01(spark, sf_dir):
    return tables.chunks(spark, sf_dir).where("vector IS NOT NULL").select("id", F.round(vectors.cosine_distance(F.col("vector"), probe_vector(spark, sf_dir)), 9).alias("distance"))


@query("jon02_batch_of_queries", f"WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), {C}, d AS (SELECT qid, id, {_DIST} AS distance FROM chunks, q WHERE vector IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS nth FROM d) SELECT qid, id, abs(round(distance, 6)) AS distance FROM r WHERE nth <= 5")
def jon02(spark, sf_dir):
    return search.search_batch(tables.chunks(spark, sf_dir), asked_vectors(spark, sf_dir), 5).select("qid", "id", F.abs(F.round("distance", 6)).alias("distance"))


def asked_vectors(spark, sf_dir):
    """The batch of queries: every embedding whose id is divisible by 100."""
    return tables.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


@query("qry03_approximate_neighbours")
def qry03(spark, sf_dir):
    """Through the stored index with the reach that it has learnt."""
    return tables.vector_index(spark, sf_dir).search(asked_vectors(spark, sf_dir), 10).select("qid", "id", "distance")


@query("qry03_snk12_exact_through_index", f"WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), {C}, d AS (SELECT qid, id, {_DIST} AS distance FROM chunks, q WHERE vector IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS nth FROM d WHERE distance IS NOT NULL) SELECT qid, id, abs(round(distance, 6)) AS distance FROM r WHERE nth <= 10")
def qry03_exact(spark, sf_dir):
    """Through the same index with bands that can't miss a neighbour."""
    found = tables.vector_index(spark, sf_dir).search(asked_vectors(spark, sf_dir), 10, reach=1.0)
    return found.select("qid", "id", F.abs(F.round("distance", 6)).alias("distance"))


@query("qry03_snk12_filtered_in_index", f"WITH {C}, {_Q}, n AS ({_near_sql(chr(39).join(['chunk_type = ', 'turn', ' AND project_name = ', 'src5', '']), 15)}) SELECT id, distance FROM n")
def qry03_filtered(spark, sf_dir):
    """One query with filters on columns that the index stores: no join with the chunks."""
    wanted = (F.col("chunk_type") == "turn") & (F.col("project_name") == "src5")
    return tables.vector_index(spark, sf_dir).one(probe_vector(spark, sf_dir), 15, reach=1.0, condition=wanted)[0]


@query("jon01_late_materialisation", f"WITH {C}, {_Q}, n AS ({_near_sql('true', 100)}) SELECT id, length(content) AS n_chars, project_name FROM chunks JOIN n USING (id)")
def jon01(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    near = search.vector_candidates(c, probe_vector(spark, sf_dir), 100)
    return c.join(F.broadcast(near), "id").select("id", F.length("content").cast("long").alias("n_chars"), "project_name")


@query("jon13_ranks_with_offset", f"WITH {C}, {_Q}, n AS ({_near_sql('true', 50)}), l AS (SELECT list(id ORDER BY distance, id) AS ids FROM n) SELECT unnest(ids) AS id, unnest(range(0, len(ids))) AS rank FROM l")
def jon13(spark, sf_dir):
    near = search.vector_candidates(tables.chunks(spark, sf_dir), probe_vector(spark, sf_dir), 50)
    ids = near.agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("l"))  # 50 rows
    return ids.select(F.posexplode("l").alias("rank", "x")).select(F.col("x.id").alias("id"), F.col("rank").cast("long").alias("rank"))


@query("flt09_full_text_match", f"WITH {C} SELECT id FROM chunks WHERE list_has_any(regexp_extract_all(lower(content), '[\\pL\\pN_]+'), ['shnt', 'und'])")
def flt09(spark, sf_dir):
    from ..functions.text import tokens

    return tables.chunks(spark, sf_dir).where(F.arrays_overlap(tokens(F.col("content")), F.array(F.lit("shnt"), F.lit("und")))).select("id")


def _filter(name: str, where: str, filters: search.Filters):
    @query(name, f"WITH {C} SELECT id, chunk_type, project_name FROM chunks WHERE {where}")
    def run(spark, sf_dir):
        return tables.chunks(spark, sf_dir).where(filters.condition()).select("id", "chunk_type", "project_name")


_filter("flt01_project", "project_path = '/work/src4'", search.Filters(project_path="/work/src4"))
_filter("flt02_chunk_type", "chunk_type = 'summary'", search.Filters(chunk_type="summary"))
_filter("flt03_flt11_file_contains", "contains(file_path, 'src2/file_')", search.Filters(file_path="src2/file_"))
_filter("flt04_file_like", "file_path LIKE '%src_/file%'", search.Filters(file_like="src_/file"))
_filter("flt05_operation", "operation = 'write'", search.Filters(operation="write"))
_filter("flt06_time_bounds", "timestamp >= TIMESTAMP '2026-01-01 02:00:00' AND timestamp <= TIMESTAMP '2026-01-01 04:00:00'", search.Filters(date_from="2026-01-01 02:00:00", date_to="2026-01-01 04:00:00"))


@query("flt07_embedded_only", f"WITH {C} SELECT id FROM chunks WHERE vector IS NOT NULL")
def flt07(spark, sf_dir):
    return tables.chunks(spark, sf_dir).where("vector IS NOT NULL").select("id")


@query("flt12_arr01_valid_vectors", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: abs(x) >= 1e-10)) > 0 AS valid FROM embeddings")
def flt12(spark, sf_dir):
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", vectors.is_valid(F.col("embedding"), 64).alias("valid"))


@query("snk15_index_partitions", f"WITH {C}, n AS (SELECT count(*) AS n FROM chunks) SELECT n, least(greatest(least(CAST(floor(sqrt(n)) AS BIGINT), 2048), 64), n) AS cells FROM n")
def snk15(spark, sf_dir):
    return tables.chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select("n", vectors.index_partitions(F.col("n")).alias("cells"))


@query("src18_point_lookup", f"WITH {C} SELECT id, doc_id, session_id FROM chunks WHERE id = substr(sha256('chunk-11'), 1, 16)")
def src18(spark, sf_dir):
    import hashlib

    from ..operators import store

    return store.by_id(tables.chunks(spark, sf_dir), hashlib.sha256(b"chunk-11").hexdigest()[:16]).select("id", "doc_id", "session_id")
