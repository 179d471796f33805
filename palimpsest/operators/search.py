"""Retrieval: filters, exact and approximate nearest neighbours, full text, hybrid ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import tokens
from ..functions.vectors import cosine_distance
from ..schema import RESULT_COLUMNS
from . import blocks
from .textindex import TextIndex


@dataclass(frozen=True)
class Filters:
    """Conditions on chunks; those that are None do not apply."""

    project_path: str | None = None
    project_name: str | None = None
    chunk_type: str | None = None
    file_path: str | None = None  # contained in the path, no wildcards
    file_like: str | None = None  # a LIKE pattern's inside, wildcards count
    operation: str | None = None
    session_id: str | None = None
    date_from: str | None = None  # UTC, inclusive
    date_to: str | None = None

    def condition(self) -> Column:
        equal = [F.col(c) == getattr(self, c) for c in ("project_path", "project_name", "chunk_type", "operation", "session_id") if getattr(self, c) is not None]
        if self.file_path is not None:
            equal.append(F.col("file_path").contains(self.file_path))
        if self.file_like is not None:
            equal.append(F.col("file_path").like(f"%{self.file_like}%"))
        if self.date_from is not None:
            equal.append(F.col("timestamp") >= F.lit(self.date_from).cast("timestamp"))
        if self.date_to is not None:
            equal.append(F.col("timestamp") <= F.lit(self.date_to).cast("timestamp"))
        return reduce(lambda a, b: a & b, equal, F.lit(True))


def check_limit(limit: int, most: int = 100) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must lie between 1 and {most}")
    return limit


def vector_candidates(chunks: DataFrame, query: list[float], pool: int, filters: Filters = Filters()) -> DataFrame:
    """The ``pool`` nearest chunks by cosine distance: id, distance. Ties go by id."""
    near = chunks.where(F.col("vector").isNotNull() & filters.condition()).select("id", F.round(cosine_distance(F.col("vector"), query), 9).alias("distance"))
    return near.where("distance IS NOT NULL").orderBy("distance", "id").limit(pool)


def text_candidates(chunks: DataFrame, question: str, pool: int, filters: Filters = Filters(), index: TextIndex | None = None) -> DataFrame:
    """The ``pool`` best chunks by BM25 over the question's terms: id, relevance.

    With an index its postings give each chunk's length and how often it has each
    term, and without filters only blocks that may hold one of the best are scored. Without
    an index all texts are read, for the counts and again for the statistics (document
    counts and the mean length, one row).
    """
    terms = sorted(set(_tokens(question)))
    if not terms:
        return chunks.select("id", F.lit(0.0).alias("relevance")).limit(0)
    if index is not None:
        return index.best(terms, pool) if filters == Filters() else _bm25(*index.counted(terms, filters.condition()), len(terms), pool)
    words = chunks.where(filters.condition()).select("id", tokens(F.col("content")).alias("w"))
    counted = words.select("id", F.size("w").alias("n"), *[_count(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    return _bm25(counted.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0), stats, len(terms), pool)


def _bm25(counted: DataFrame, stats: DataFrame, terms: int, pool: int) -> DataFrame:
    both = counted.join(F.broadcast(stats))  # one row of statistics
    k, b = fixed.BM25_K1, fixed.BM25_B
    total = F.lit(0.0)
    for i in range(terms):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        total = total + idf * tf * (k + 1) / (tf + k * (1 - b + b * F.col("n") / F.col("mean")))
    return both.select("id", F.round(total, 9).alias("relevance")).orderBy(F.desc("relevance"), "id").limit(pool)


def _count(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def _tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def _ranked(pool: DataFrame, order: list, k: int) -> DataFrame:
    """id and reciprocal rank 1 / (k + rank + 1), rank from 0; the pool is a short list."""
    rank = F.row_number().over(Window.orderBy(*order))
    return pool.select("id", (F.lit(1.0) / (rank + F.lit(k))).alias("part"))


def fused(vector: DataFrame, text: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two candidate lists: id, score (a distance: 0 is first in both)."""
    parts = _ranked(vector, ["distance", "id"], k).unionByName(_ranked(text, [F.desc("relevance"), "id"], k))
    total = parts.groupBy("id").agg(F.sum("part").alias("total"))
    return total.select("id", F.round(1 - F.least(F.lit(1.0), F.col("total") / F.lit(2.0 / (k + 1))), 9).alias("score"))


def _wide(chunks: DataFrame, best: DataFrame) -> DataFrame:
    """The chunks of a short result list (at most some hundred rows), with its columns.

    The ids are in the plan as values, so that they are looked for where the chunks are read, before
    any join that the chunks are made by.
    """
    held = best.collect()
    return chunks.where(F.col("id").isin([r["id"] for r in held])).join(F.broadcast(best.sparkSession.createDataFrame(held, best.schema)), "id")


def hybrid_search(chunks: DataFrame, question: str, query: list[float], limit: int = 10, filters: Filters = Filters(), pool: int = fixed.CANDIDATE_POOL, index: TextIndex | None = None) -> DataFrame:
    """Both arms under the same filters, fused, then joined with the wide columns.

    A blank question leaves the vector arm alone. Only ids travel to the fusion.
    """
    limit = check_limit(limit)
    if not _tokens(question):
        return vector_search(chunks, query, limit, filters)
    pool = max(limit, pool)
    best = fused(vector_candidates(chunks, query, pool, filters), text_candidates(chunks, question, pool, filters, index)).orderBy("score", "id").limit(limit)
    return _wide(chunks, best).select(*RESULT_COLUMNS)


def vector_search(chunks: DataFrame, query: list[float], limit: int = 10, filters: Filters = Filters()) -> DataFrame:
    best = vector_candidates(chunks, query, check_limit(limit), filters).withColumnRenamed("distance", "score")
    return _wide(chunks, best).select(*RESULT_COLUMNS)


def text_search(chunks: DataFrame, question: str, limit: int = 10, filters: Filters = Filters(), index: TextIndex | None = None) -> DataFrame:
    """Full text alone; the score is 1 - relevance clipped to 0..1."""
    best = text_candidates(chunks, question, check_limit(limit), filters, index)
    best = best.select("id", (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("relevance")))).alias("score"), "relevance")
    return _wide(chunks, best).select(*RESULT_COLUMNS, "relevance")


def search_batch(chunks: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Nearest chunks of each query (qid, vector), however many: qid, id, distance, nth.

    Queries and chunks meet in blocks on the executors; zero vectors are near nothing.
    """
    vectors = blocks.packed_vectors(chunks.where("vector IS NOT NULL").selectExpr("0 AS key", "id", "vector", "0D AS angle"))
    asked = blocks.packed_queries(queries.selectExpr("0 AS key", "qid", "vector", "-1D AS low", "4D AS high"))
    return blocks.nearest(vectors, asked, limit)


def train_cells(chunks: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Centroids from at most ``sample`` vectors, by spherical k-means on the driver."""
    picked = chunks.where("vector IS NOT NULL").select("id", "vector").orderBy(F.xxhash64("id")).limit(sample)
    rows = np.array([r["vector"] for r in picked.select("vector").collect()], float)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        cell = (rows @ centres.T).argmax(1)
        for c in range(len(centres)):
            own = rows[cell == c]
            if len(own):
                centres[c] = own.mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def file_change_search(chunks: DataFrame, query: list[float], limit: int = 10, path: str | None = None, operation: str | None = None) -> DataFrame:
    if path is not None and ".." in path:
        return vector_search(chunks, query, limit).limit(0)
    return vector_search(chunks, query, limit, Filters(chunk_type="file_change", file_path=path, operation=operation))


def session_summaries(chunks: DataFrame, query: list[float], count: int = 5, session: str | None = None, once_a_session: bool = False) -> DataFrame:
    """Nearest summaries: more are fetched, then filtered by session or cut to one a session."""
    count = max(1, min(20, count))
    fetched = count * (50 if session is not None else 3)
    best = vector_candidates(chunks, query, fetched, Filters(chunk_type="summary")).withColumnRenamed("distance", "score")
    rows = _wide(chunks, best).select(*RESULT_COLUMNS)
    if session is not None:
        rows = rows.where(F.col("session_id") == session)
    if once_a_session:
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy("score", "id"))).where("nth = 1").drop("nth")
    return rows.orderBy("score", "id").limit(count)
