"""Exact top-k by inner product with the three-phase uniform threshold algorithm.

The components are cut into m segments. A segment's products with a query are one of m
lists of local scores, and a score is the sum over the lists.

1. Gather: from each block of vectors every list sends its k highest local scores.
   The scores of these rows are resolved; the k-th highest of different rows over all
   blocks, t, is reached by k rows.
2. Cutoff: a row of score t or more has a local score of t / m or more in some list. So
   every list collects, of all vectors, the entries of t / m or more; t comes with the
   query. Entries are dropped where their local scores sum up to less than t.
3. Resolve: the entries left get exact integer scores, and the k best of each task
   and then of all are kept.

Local scores are floating-point products of matrices; thresholds are lowered by more
than their rounding, and only exact integers decide. A query with fewer than k
candidates has no cutoff and collects all.

Vectors and queries travel in blocks of bounded size: every block of queries meets every
block of vectors once in each of two passes. Query blocks are broadcast only when all of them
together are small; beyond that the blocks meet in a partition-by-partition
product, and neither the driver nor a task ever holds all queries. What a task
keeps of a query is its k best. No row is sent for a pair: a task sends k rows a
query at most, and ranking keeps k of them before the shuffle. A hot
vector, copied a thousand times, thus costs k rows a task, and its ties go to
the smaller id. Blocks are Parquet tables in the shared folder.

Defined results: rows whose vector is null or holds null or non-finite components take
no part. Shorter vectors end in zeros. Components are limited to a magnitude whose
products fit in a long (2^28 at 64 components). A null id is no query; as a candidate it
comes last among equal scores. A query's own row is every row with its id; each
repeated row is a query with its own result and a candidate. A query without candidates has no
rows, nor has an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, save
from .vectors import numbered, product_limit, whole_numbers, width_of

K, SEGMENTS, EVERY, FACTOR = 10, 4, 100, 1024
#: Bytes of a block of vectors and of a block of queries.
VECTOR_BYTES, QUERY_BYTES = 1 << 19, 1 << 17
#: Query blocks are broadcast while they have so many bytes together.
BROADCAST_BYTES = 1 << 25
#: Pairs of blocks in an Arrow batch.
PAIRS = "8"
#: Local scores are trusted to this share of the product of the norms.
SLACK = 1e-12
_BLOCK = "n int, ids binary, missing binary, numbers binary"
_NO_ID = np.iinfo(np.int64).max


def _pack(ids: pa.Array, x: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    missing = np.asarray(ids.is_null())
    return len(x), np.asarray(ids.fill_null(_NO_ID), np.int64).tobytes(), missing.tobytes(), x.astype(np.int32).tobytes()


def _vector_blocks(width: int, factor: int, limit: int):
    step = max(16, VECTOR_BYTES // (4 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            packed = []
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                packed.append(_pack(batch.column("id"), whole_numbers(batch.column("vector"), width, factor, limit)))
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packed, strict=True), [pa.int32(), *[pa.binary()] * 3], strict=True)], ["n", "ids", "missing", "numbers"])

    return run


def _query_blocks(width: int, factor: int, limit: int):
    def run(group: pa.Table) -> pa.Table:
        x = whole_numbers(group.column("vector").combine_chunks(), width, factor, limit)
        n, ids, _, numbers = _pack(group.column("id").combine_chunks(), x)
        cutoff = group.column("cutoff")
        known = ~np.asarray(cutoff.combine_chunks().is_null())
        row = (group.column("block")[0].as_py(), n, np.asarray(group.column("q"), np.int64).tobytes(), ids, numbers, np.asarray(cutoff.combine_chunks().fill_null(0), np.int64).tobytes(), known.tobytes())
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["block", "q_n", "qs", "q_ids", "q_numbers", "cutoffs", "known"])

    return run


_QUERY_BLOCK = "block long, q_n int, qs binary, q_ids binary, q_numbers binary, cutoffs binary, known binary"


class _Pair:
    """A block of queries and a block of vectors."""

    def __init__(self, row: dict, segments: int):
        self.block, self.qs = row["block"], np.frombuffer(row["qs"], np.int64)
        self.q_ids, self.ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.missing = np.frombuffer(row["missing"], bool)
        self.x = np.frombuffer(row["q_numbers"], np.int32).reshape(row["q_n"], -1)
        self.y = np.frombuffer(row["numbers"], np.int32).reshape(row["n"], -1)
        self.cutoffs, self.known = np.frombuffer(row["cutoffs"], np.int64), np.frombuffer(row["known"], bool)
        self.cuts = np.array_split(np.arange(self.x.shape[1]), min(segments, self.x.shape[1]))

    def lists(self) -> Iterator[np.ndarray]:
        """The local scores of each segment; a query's own rows are left out."""
        own = (self.q_ids[:, None] == self.ids[None, :]) & ~self.missing[None, :]
        for cut in self.cuts:
            local = self.x[:, cut].astype(np.float64) @ self.y[:, cut].astype(np.float64).T
            local[own] = -np.inf
            yield local

    def margin(self) -> np.ndarray:
        """More than the rounding of a sum of local scores, for each query."""
        longest = np.sqrt((self.y.astype(np.float64) ** 2).sum(1).max(initial=0))
        return SLACK * longest * np.sqrt((self.x.astype(np.float64) ** 2).sum(1))

    def exact(self, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.x[at].astype(np.int64), self.y[of].astype(np.int64))


class _Best:
    """The k best entries of each query of a block, among those told so far."""

    def __init__(self, qs: np.ndarray, k: int):
        self.qs, self.k, self.held, self.count = qs, k, [], 0

    def tell(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        self.held.append((at, scores, ids, missing))
        self.count += len(at)
        if self.count > 4 * self.k * len(self.qs):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        at, scores, ids, missing = map(np.concatenate, zip(*self.held, strict=True))
        order = np.lexsort((missing, ids, ~scores, at))  # ~s falls as s rises and can't overflow
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        stay = order[place < self.k]
        at, scores, ids, missing = at[place < self.k], scores[stay], ids[stay], missing[stay]
        self.held, self.count = [(at, scores, ids, missing)], len(at)
        return at, scores, ids, missing


def _searched(find, k: int, segments: int):
    """Runs ``find`` (pair) -> entries over all pairs of a task and sends the k best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                pair = _Pair(row, segments)
                best.setdefault(pair.block, _Best(pair.qs, k)).tell(*find(pair, k))
        for found in best.values():
            at, scores, ids, missing = found.cut()
            yield pa.RecordBatch.from_arrays([pa.array(found.qs[at]), pa.array(ids, mask=missing), pa.array(scores)], ["q", "id", "score"])

    return run


def _gathered(pair: _Pair, k: int):
    """Phase 1: the rows of the k highest local scores of each list, once each, with their scores."""
    n, held = len(pair.ids), []
    for local in pair.lists():
        top = np.argpartition(local, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), local.shape)
        at = np.repeat(np.arange(len(local)), top.shape[1])
        of = top.ravel()
        real = local[at, of] > -np.inf
        held.append(at[real] * n + of[real])
    each = np.unique(np.concatenate(held))
    at, of = each // n, each % n
    return at, pair.exact(at, of), pair.ids[of], pair.missing[of]


def _collected(pair: _Pair, k: int):
    """Phases 2 and 3: entries of a list at or above the uniform threshold, resolved where their sum may reach the cutoff."""
    margin, n = pair.margin(), len(pair.ids)
    cutoff = np.where(pair.known, pair.cutoffs.astype(np.float64) - margin - SLACK * np.abs(pair.cutoffs), -np.inf)
    total, some = 0, False
    for local in pair.lists():
        some = some | (local >= (cutoff / len(pair.cuts) - margin)[:, None])
        total = total + local
    at, of = np.nonzero(some & (total > -np.inf))
    stay = total[at, of] >= cutoff[at]
    at, of = at[stay], of[stay]
    scores = pair.exact(at, of)
    reached = ~pair.known[at] | (scores >= pair.cutoffs[at])
    return at[reached], scores[reached], pair.ids[of[reached]], pair.missing[of[reached]]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank; Spark keeps k a task before it shuffles."""
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pass(vectors: DataFrame, queries: DataFrame, find, k: int, segments: int, name: str) -> DataFrame:
    spark = vectors.sparkSession
    held = queries.agg(F.sum(F.octet_length("q_numbers"))).first()[0] or 0
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", PAIRS)
    try:
        pairs = vectors.crossJoin(F.broadcast(queries) if held <= BROADCAST_BYTES else queries)
        return save(pairs.mapInArrow(_searched(find, k, segments), "q long, id long, score long"), name)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, segments: int = SEGMENTS, factor: int = FACTOR) -> DataFrame:
    """query_id, rank, id, score: for each row whose id ``every`` divides, the k best rows with other ids."""
    rows = numbered(df, id_col, vector_col)
    width = max(width_of(rows), 1)
    limit = product_limit(width)
    vectors = save(rows.mapInArrow(_vector_blocks(width, factor, limit), _BLOCK), "vector-blocks")
    queries = save(rows.where(F.col("id") % every == 0).withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = max(1, queries.count() * 4 * width // QUERY_BYTES)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))

    def packed(told: DataFrame, name: str) -> DataFrame:
        return save(told.groupBy("block").applyInArrow(_query_blocks(width, factor, limit), _QUERY_BLOCK), name)

    plain = packed(dealt.withColumn("cutoff", F.lit(None).cast("long")), "query-blocks")
    gathered = _pass(vectors, plain, _gathered, k, segments, "gathered")
    cutoffs = _ranked(gathered, k).where(F.col("rank") == k).select("q", F.col("score").alias("cutoff"))
    bounded = packed(dealt.join(cutoffs, "q", "left"), "query-blocks-bounded")
    found = _pass(vectors, bounded, _collected, k, segments, "collected")
    discard(vectors, plain, gathered, bounded)
    best = _ranked(found, k).withColumnRenamed("id", "found")
    return best.join(queries.select("q", F.col("id").alias("query_id")), "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("id"), "score")


def op13_uniform_threshold(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id").select("query_id", "rank", "vec_id", "score")


OP13_SQL = """
WITH k AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: x.v[i] * q.v[i])) AS BIGINT) AS score
      FROM k q JOIN k x ON q.vec_id % 100 = 0 AND x.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 10
"""
