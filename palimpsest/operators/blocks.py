"""Many queries against many vectors: blocks of both, multiplied in tasks, the best of each query merged.

Queries are a table like the vectors. Neither side passes through the driver: vectors
are packed where they are read, queries are packed by a shuffle of the queries alone, and each
block of vectors meets each block of queries that belongs to it once. A task
sends the best ``limit`` rows of a query, so what is shuffled does not grow with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..paths import scratch

#: Vectors and queries in a block, and pairs of blocks in an Arrow batch.
VECTORS, QUERIES, PAIRS = 2048, 256, "8"
#: Query blocks go to all executors while they have at most so many bytes together.
BROADCAST_BYTES = 1 << 25
_ROW = "key int, ids array<string>, angles binary, matrix binary"
_ASKED = "key int, qids binary, lows binary, highs binary, asked binary"


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1 (or 0); vectors of one table have one width."""
    flat = np.asarray(vectors.flatten(), np.float64)
    rows = flat.reshape(len(vectors), -1) if len(flat) else np.zeros((len(vectors), 1))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def packed_vectors(rows: DataFrame) -> DataFrame:
    """(key, id, vector, angle) as blocks of one key each, packed where they are read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, angles = np.asarray(batch.column("key")), batch.column("id"), np.asarray(batch.column("angle"), np.float64)
            matrix, out = unit(batch.column("vector")), []
            order = np.argsort(keys, kind="stable")
            for run in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                for a in range(0, len(run), VECTORS):
                    at = run[a : a + VECTORS]
                    out.append((int(keys[at[0]]), ids.take(pa.array(at)).to_pylist(), angles[at].tobytes(), matrix[at].tobytes()))
            if len(keys):
                yield _batch(list(zip(*out, strict=True)), _ROW)

    return rows.select(F.col("key").cast("int").alias("key"), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("angle").cast("double").alias("angle")).mapInArrow(pack, _ROW)


def packed_queries(queries: DataFrame) -> DataFrame:
    """(key, qid, vector, low, high) as blocks of one key each; low and high bound the angles a query wants.

    There are as many keys as an index has cells, some thousands at most.
    """

    def pack(group: pa.Table) -> pa.Table:
        one = group.combine_chunks()
        take = lambda c, t: np.asarray(one.column(c), t).tobytes()
        matrix = unit(one.column("vector").combine_chunks())
        row = [[one.column("key")[0].as_py()], [take("qid", np.int64)], [take("low", np.float64)], [take("high", np.float64)], [matrix.tobytes()]]
        return pa.Table.from_batches([_batch(row, _ASKED)])

    rows = queries.select(F.col("key").cast("int").alias("key"), F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"), "low", "high")
    counts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts"))
    dealt = rows.join(F.broadcast(counts), "key").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")))
    return dealt.groupBy("key", "part").applyInArrow(pack, _ASKED)


def _best(names: np.ndarray, ids: np.ndarray, far: np.ndarray, limit: int) -> list:
    """(qid, id, distance) of the best ``limit`` finite distances in each row of ``far``; of equal ones the least ids."""
    if far.shape[1] > limit:
        last = np.partition(far, limit - 1, 1)[:, limit - 1 : limit]
        query, row = np.nonzero((far <= last) & (far < np.inf))
    else:
        query, row = np.nonzero(far < np.inf)
    order = np.lexsort((ids[row], far[query, row], query))
    query, row = query[order], row[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < limit
    query, row = query[keep], row[keep]
    return [names[query], ids[row], far[query, row]]


def _answers(limit: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def cut():
            names, ids, far = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((ids, far, names))
            names, ids, far = names[order], ids[order], far[order]
            keep = np.arange(len(names)) - np.searchsorted(names, names) < limit
            held[:] = [[names[keep], ids[keep], far[keep]]]
            return len(held[0][0])

        size, most = 0, 1 << 18
        for batch in batches:
            for row in batch.to_pylist():
                names = np.frombuffer(row["qids"], np.int64)
                ids = np.array(row["ids"], object)
                asked = np.frombuffer(row["asked"]).reshape(len(names), -1)
                rows = np.frombuffer(row["matrix"]).reshape(len(ids), -1)
                far = np.round(1 - asked @ rows.T, 9) + 0.0
                far[:, ~rows.any(1)] = far[~asked.any(1)] = np.inf  # zero vectors have no direction
                angles = np.frombuffer(row["angles"])
                low, high = (np.frombuffer(row[c])[:, None] for c in ("lows", "highs"))
                far[(angles[None] < low) | (angles[None] > high)] = np.inf
                held.append(_best(names, ids, far, limit))
                size += len(held[-1][0])
            if size > most:
                size = cut()
                most = max(most, 2 * size)
        if held:
            cut()
            yield _batch([held[0][0], held[0][1].tolist(), held[0][2]], "qid long, id string, distance double")

    return answer


def nearest(vectors: DataFrame, queries: DataFrame, limit: int, by_key: bool = False) -> DataFrame:
    """(qid, id, distance, nth): the best ``limit`` vectors of each query, ties by id, rounded cosine distances.

    ``vectors`` and ``queries`` come from :func:`packed_vectors` and :func:`packed_queries`.
    With ``by_key`` blocks of one key meet, else all of them, partition by partition. What
    each task found is written to the shared folder, so the merge can be repeated.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "query-blocks")
    queries.write.parquet(path)
    queries = spark.read.schema(_ASKED).parquet(path)
    small = (queries.agg(F.sum(F.octet_length("asked"))).first()[0] or 0) <= BROADCAST_BYTES
    asked = F.broadcast(queries) if small else queries
    pairs = vectors.join(asked, "key") if by_key else vectors.drop("key").crossJoin(asked.drop("key"))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(setting), scratch(spark, "nearest")
    spark.conf.set(setting, PAIRS)  # a pair of blocks is large
    try:
        pairs.mapInArrow(_answers(limit), "qid long, id string, distance double").write.parquet(found)
    finally:
        spark.conf.set(setting, before)
    return ranked(spark.read.schema("qid long, id string, distance double").parquet(found), limit)


def ranked(found: DataFrame, limit: int) -> DataFrame:
    """Spark ranks within each task before it shuffles, so ``limit`` rows of a query leave a task at most."""
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= limit)
