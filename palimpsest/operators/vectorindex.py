"""A stored vector index that prunes: cells around centres, rows ordered by their angle to the centre.

With b the angle between a query and a cell's centre and a that of a row in the
cell, their similarity is cos a cos b + sin a sin b z for some z of at most 1. A search

1. reads the cells nearest to the query, which gives a similarity t that ``limit`` rows reach;
2. reads of each other cell the band of angles a for which z = ``reach`` allows t.

With reach 1 no neighbour can be missed. The index learns a smaller reach from a
bounded sample of its own rows so that a wanted share of true neighbours stays in the bands;
a search without an explicit reach uses it. Cells are folders and rows are
sorted by angle, so both prunings reach the Parquet scan.

Centres are fitted on at most SAMPLE rows, the reach on at most TRIED rows against all;
every row with a vector is indexed. Rows with a zero vector have no angle and are never near
anything; rows of other widths are refused when the index is built.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance
from ..paths import stored
from . import blocks
from .search import train_cells

#: Rows that the centres are fitted on, and rows that the reach is fitted on.
SAMPLE, TRIED = 20_000, 64
#: Cells read first, and the share of true neighbours that the learnt reach keeps on the sample.
FIRST, KEPT = 8, 0.92
#: Cells to a partition of the fixed rule below: finer cells leave less angle to the rows in them.
CELLS_EACH = 2
#: Filters on cells and angles that one query gives to the scan: cells with similar bands share one.
GROUPS = 32
#: Numbers that a task makes at once: similarities of rows to centres, or vectors beside each cell.
AT_ONCE = 1 << 21
#: Columns stored beside the vectors, so that filters need no join.
STORED = ("chunk_type", "session_id", "project_name", "machine_id")
_CELL = "id string, vector array<float>, cell int, angle double"


def cells_for(rows: int) -> int:
    """Fixed rule: the root of the rows, between 64 and 2048, and no more than rows."""
    return max(1, min(max(64, min(2048, int(rows**0.5))), rows))


def band(angle: Column, similarity: Column, reach: float) -> tuple[Column, Column]:
    """The angles to a centre, at ``angle`` from the query, that rows of ``similarity`` may have; low > high if none."""
    ahead, aside = F.cos(angle), F.lit(reach) * F.sin(angle)
    size = F.greatest(F.sqrt(ahead * ahead + aside * aside), F.lit(1e-12))
    share = similarity / size
    half = F.when(share > 1, F.lit(-1.0)).otherwise(F.acos(F.greatest(F.least(share, F.lit(1.0)), F.lit(-1.0))) + 1e-6)
    middle = F.atan2(aside, ahead)
    return middle - half, middle + half


class VectorIndex:
    """The index in a folder: rows/cell=.../, centres and settings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return stored(self.spark, f"{self.path}/settings/_SUCCESS")

    def build(self, chunks: DataFrame, cells: int | None = None, limit: int = 10) -> VectorIndex:
        rows = chunks.where("vector IS NOT NULL")
        kept = [c for c in STORED if c in chunks.columns]
        widths = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
        if widths["least"] != widths["most"]:
            raise ValueError("vectors of one index have one width")
        centres = train_cells(rows, cells or min(CELLS_EACH * cells_for(widths["n"]), widths["n"]), SAMPLE) if widths["n"] else np.zeros((0, 0))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, max(1, AT_ONCE // len(centres))):
                    batch = whole.slice(a, max(1, AT_ONCE // len(centres)))
                    unit = blocks.unit(batch.column("vector"))
                    ahead = unit @ centres.T
                    cell = ahead.argmax(1)
                    angle = np.where(unit.any(1), np.arccos(np.clip(ahead[np.arange(len(unit)), cell], -1, 1)), np.nan)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell, pa.int32()), pa.array(angle), *[batch.column(c) for c in kept]], ["id", "vector", "cell", "angle", *kept])

        shape = ", ".join([_CELL, *[f"{c} {chunks.schema[c].dataType.simpleString()}" for c in kept]])
        placed = rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), *kept).mapInArrow(place, shape)
        # ranges of (cell, angle): a cell with a third of the rows becomes several files, each a ring
        placed = placed.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle")
        placed.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        spread = self.rows().where(~F.isnan("angle")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
        known = self.spark.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(centres)], "cell int, centre array<double>")  # their number is bounded
        known.join(spread, "cell", "left").fillna({"n": 0}).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        reach = self._learnt(limit) if widths["n"] else 1.0
        self.spark.createDataFrame([(float(reach), int(widths["n"]))], "reach double, n long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def centres(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centres")

    def reach(self) -> float:
        return self.spark.read.parquet(f"{self.path}/settings").first()["reach"]

    def angles(self, queries: DataFrame) -> DataFrame:
        """(qid, vector, cell, angle, place): each query's angle to every cell that has rows, and its place by angle."""
        held = self.centres().where("n > 0").orderBy("cell").collect()  # at most CELLS_EACH * 2048 of them
        numbers, matrix = np.array([r["cell"] for r in held], np.int32), np.array([r["centre"] for r in held], float)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, min(256, AT_ONCE // (len(numbers) * matrix.shape[1])))
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    unit = blocks.unit(part.column("vector"))
                    angle = np.where(unit.any(1, keepdims=True), np.arccos(np.clip(unit @ matrix.T, -1, 1)), np.pi / 2)
                    place = angle.argsort(1, kind="stable").argsort(1)
                    at = pa.array(np.repeat(np.arange(part.num_rows), len(numbers)))
                    yield pa.RecordBatch.from_arrays([part.column("qid").take(at), part.column("vector").take(at), pa.array(np.tile(numbers, part.num_rows)), pa.array(angle.ravel()), pa.array(place.ravel().astype(np.int32))], ["qid", "vector", "cell", "angle", "place"])

        asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
        if not len(numbers):
            return asked.selectExpr("*", "0 AS cell", "0D AS angle", "0 AS place").limit(0)
        return asked.mapInArrow(measure, "qid long, vector array<double>, cell int, angle double, place int")

    def bands(self, angles: DataFrame, reached: DataFrame, reach: float) -> DataFrame:
        """(qid, vector, cell, low, high): what each query reads beyond its first cells, given (qid, t)."""
        low, high = band(F.col("angle"), F.col("t"), reach)
        later = angles.where(F.col("place") >= FIRST).join(reached, "qid", "left").withColumn("t", F.coalesce("t", F.lit(-1.0)))
        later = later.select("qid", "vector", "cell", low.alias("low"), high.alias("high"))
        spread = self.centres().select("cell", "least", "most")
        return later.join(F.broadcast(spread), "cell").where("low <= most AND high >= least").drop("least", "most")

    def search(self, queries: DataFrame, limit: int, reach: float | None = None) -> DataFrame:
        """(qid, id, distance, nth) for queries (qid, vector); a reach of 1 is exact."""
        reach = self.reach() if reach is None else reach
        angles = self.angles(queries)
        near = self._first(angles, limit)
        reached = near.where(F.col("nth") == limit).select("qid", (1 - F.col("distance") - 1e-8).alias("t"))
        more = self._read(self.bands(angles, reached, reach), limit)
        return blocks.ranked(near.drop("nth").unionByName(more.drop("nth")), limit)

    def _first(self, angles: DataFrame, limit: int) -> DataFrame:
        return self._read(angles.where(F.col("place") < FIRST).selectExpr("qid", "vector", "cell", "-1D AS low", "4D AS high"), limit)

    def _read(self, wanted: DataFrame, limit: int) -> DataFrame:
        rows = self.rows().where(~F.isnan("angle"))
        vectors = blocks.packed_vectors(rows.select(F.col("cell").alias("key"), "id", "vector", "angle"))
        return blocks.nearest(vectors, blocks.packed_queries(wanted.withColumnRenamed("cell", "key")), limit, by_key=True)

    def one(self, query: list[float], limit: int, reach: float | None = None, condition: Column | None = None) -> tuple[DataFrame, list[DataFrame]]:
        """(id, distance) of one query, and the reads of the index that it makes.

        ``condition`` is on the stored columns. All of it stays in the JVM: folders and
        row groups are pruned by the cells and bands, which are literals. Of an index with
        thousands of cells these would be too many for one filter, so cells with similar bands share a
        condition on the scan, and what it lets through is compared with the own band of its cell.
        """
        reach = self.reach() if reach is None else reach
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, vector array<double>")
        angles = self.angles(asked).collect()  # one row a cell
        far = F.round(cosine_distance(F.col("vector"), query), 9)

        def best(read: Column, bands: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
            rows = self.rows().where(read & ~F.isnan("angle"))
            if bands is not None:
                rows = rows.join(F.broadcast(bands), "cell").where("angle BETWEEN low AND high").drop("low", "high")
            wanted = rows if condition is None else rows.where(condition)
            return rows, wanted.select("id", far.alias("distance")).where("distance IS NOT NULL").orderBy("distance", "id").limit(limit)

        reads, first = best(F.col("cell").isin([r["cell"] for r in angles if r["place"] < FIRST]))
        held = first.collect()  # limit rows
        t = 1 - held[-1]["distance"] - 1e-8 if len(held) == limit else -1.0
        known = self.spark.createDataFrame(angles, "qid long, vector array<double>, cell int, angle double, place int")
        later = self.bands(known, self.spark.createDataFrame([(0, float(t))], "qid long, t double"), reach).collect()
        both = self.spark.createDataFrame(held, "id string, distance double")
        if not later:
            return both, [reads]
        later.sort(key=lambda r: (r["low"], r["high"]))
        groups = [part for part in (later[len(later) * i // GROUPS : len(later) * (i + 1) // GROUPS] for i in range(GROUPS)) if part]
        read = [F.col("cell").isin([r["cell"] for r in part]) & F.col("angle").between(part[0]["low"], max(r["high"] for r in part)) for part in groups]
        own = self.spark.createDataFrame([(r["cell"], r["low"], r["high"]) for r in later], "cell int, low double, high double") if len(later) > len(groups) else None
        more, second = best(reduce(operator.or_, read), own)
        return both.unionByName(second).orderBy("distance", "id").limit(limit), [reads, more]

    def pairs_read(self, queries: DataFrame, limit: int, reach: float | None = None) -> DataFrame:
        """One row (compared, pairs): how many pairs of query and row a search compares, of how many."""
        angles = self.angles(queries)
        near = self._first(angles, limit)
        reached = near.where(F.col("nth") == limit).select("qid", (1 - F.col("distance") - 1e-8).alias("t"))
        later = self.bands(angles, reached, self.reach() if reach is None else reach).select("qid", "cell", "low", "high")
        asked = angles.where(F.col("place") < FIRST).selectExpr("qid", "cell", "-1D AS low", "4D AS high").unionByName(later)
        # angles are counted on a grid of cells and rings, so no pair is made
        rings = self.rows().where(~F.isnan("angle")).groupBy("cell", F.floor(F.col("angle") * RINGS).alias("ring")).agg(F.count(F.lit(1)).alias("n"))
        ring = F.explode(F.sequence(F.floor(F.greatest("low", F.lit(0.0)) * RINGS), F.greatest(F.floor(F.least("high", F.lit(3.15)) * RINGS), F.floor(F.greatest("low", F.lit(0.0)) * RINGS))))
        read = asked.select("qid", "cell", ring.alias("ring")).join(rings, ["cell", "ring"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
        return read.crossJoin(queries.agg(F.count(F.lit(1)).alias("q"))).crossJoin(self.rows().agg(F.count(F.lit(1)).alias("n"))).select("compared", (F.col("q") * F.col("n")).alias("pairs"))

    def _learnt(self, limit: int) -> float:
        """The least reach with which the bands hold the share KEPT of the true neighbours of a sample."""
        tried = self.rows().where(~F.isnan("angle")).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(TRIED).withColumn("qid", F.monotonically_increasing_id())
        queries = self.spark.createDataFrame(tried.select("qid", "vector").collect(), "qid long, vector array<double>")  # TRIED rows
        angles = self.angles(queries)
        reached = self._first(angles, limit).where(F.col("nth") == limit).select("qid", (1 - F.col("distance") - 1e-8).alias("t"))
        everything = blocks.packed_vectors(self.rows().where(~F.isnan("angle")).selectExpr("0 AS key", "id", "vector", "angle"))
        asked = blocks.packed_queries(queries.selectExpr("0 AS key", "qid", "vector", "-1D AS low", "4D AS high"))
        true = blocks.nearest(everything, asked, limit).select("qid", "id")
        places = self.rows().select("id", "cell", F.col("angle").alias("own"))
        met = true.join(places, "id").join(angles.select("qid", "cell", "angle", "place"), ["qid", "cell"]).join(reached, "qid", "left")
        aside = F.greatest(F.sin("own") * F.sin("angle"), F.lit(1e-12))
        needed = F.when(F.col("place") < FIRST, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce("t", F.lit(-1.0)) - F.cos("own") * F.cos("angle")) / aside)))
        return met.agg(F.percentile(needed, F.lit(KEPT))).first()[0] or 0.0


#: Rings to a radian in which pairs_read counts.
RINGS = 512
