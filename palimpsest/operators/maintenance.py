"""Definition and upkeep of the chunk table: tables, indexes, models, compaction, reindexing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..paths import file_system, stored
from ..schema import CHUNKS
from .mergetable import Merged, MergeTable
from .textindex import TextIndex
from .vectorindex import VectorIndex

#: Fixed value: tables with fewer rows get no vector index.
VECTOR_INDEX_ROWS = 10_000
#: Columns that lookups go by besides the id: each has a narrow copy sorted by it.
SECONDARY = ("session_id", "project_path", "file_path", "timestamp")


def define_table(spark: SparkSession, name: str, path: str, buckets: int = 16) -> bool:
    """Create the chunk table at ``path``; an existing one is a success too. True if it is new."""
    if spark.catalog.tableExists(name):
        return False
    spark.createDataFrame([], CHUNKS).write.partitionBy("chunk_type").bucketBy(buckets, "id").sortBy("id").format("parquet").option("path", path).saveAsTable(name)
    return True


def secondary_indexes(table: DataFrame, path: str) -> list[str]:
    """Narrow copies (column, id) sorted by each lookup column; row-group statistics prune them."""
    for c in SECONDARY:
        table.where(F.col(c).isNotNull()).select(c, "id").repartitionByRange(c).sortWithinPartitions(c).write.mode("overwrite").parquet(f"{path}/{c}")
    return list(SECONDARY)


@dataclass
class Upkeep:
    rows: int
    text_index: bool
    vector_cells: int
    merged: Merged


def optimise(table: MergeTable, indexes: str, least: int = VECTOR_INDEX_ROWS) -> Upkeep:
    """Text index first, a vector index if the table is large enough, then the table's merge and vacuum.

    An index that is there is not built again; if an index fails, the merge is still
    done and the failure is raised after it.
    """
    rows, failure, cells, spark = table.read(), None, 0, table.spark
    index = TextIndex(spark, f"{indexes}/text-index")
    try:
        if not index.exists():
            index.build(rows)
        if rows.where("vector IS NOT NULL").count() >= least:
            vectors = VectorIndex(spark, f"{indexes}/vector-index")
            cells = (vectors if vectors.exists() else vectors.build(rows)).centres().count()
    except Exception as error:  # noqa: BLE001  the merge does not depend on an index
        failure = error
    merged = table.merge()
    table.vacuum()
    if failure:
        raise failure
    return Upkeep(table.read().count(), index.exists(), cells, merged)


def reindexed(spark: SparkSession, target: str, checkpoint: str, run) -> None:
    """Clear a table and its stream's offsets, then run the job anew: every file is queued again."""
    for path in (target, checkpoint):
        if stored(spark, path):
            system, at = file_system(spark, path)
            system.delete(at, True)
    run()


def mutation_values(chunks: DataFrame) -> DataFrame:
    """Chunks as values of a write: plain types, times as UTC text with microseconds, empty lists for null."""
    return chunks.select(
        F.col("id").cast("string"), F.col("content").cast("string"), "chunk_type", "session_id", F.col("source_line").cast("long").alias("source_line"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.coalesce(F.transform("vector", lambda x: x.cast("double")), F.array().cast("array<double>")).alias("vector"),
    )
