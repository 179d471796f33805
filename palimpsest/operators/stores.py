"""One interface over a chunk table, and the stores that a setting names."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..paths import file_system, scratch
from . import search, store
from .mergetable import Merged, MergeTable
from .textindex import TextIndex


class ChunkStore(Protocol):
    """What the engine asks of a store. Tables are given and returned as DataFrames."""

    def table(self) -> DataFrame: ...
    def append(self, batch: DataFrame) -> None: ...
    def upsert(self, batch: DataFrame) -> None: ...
    def delete_machine(self, machine: str) -> int: ...
    def clear(self) -> int: ...
    def by_id(self, chunk_id: str) -> DataFrame: ...
    def waiting(self, prefix: str, limit: int) -> DataFrame: ...
    def backfill(self, embed: store.Embed) -> None: ...
    def statistics(self) -> DataFrame: ...
    def positions(self) -> DataFrame: ...
    def vector_search(self, query: list[float], limit: int, filters: search.Filters) -> DataFrame: ...
    def text_search(self, question: str, limit: int, filters: search.Filters) -> DataFrame: ...
    def hybrid_search(self, question: str, query: list[float], limit: int, filters: search.Filters) -> DataFrame: ...
    def file_changes(self, query: list[float], limit: int, path: str | None, operation: str | None) -> DataFrame: ...
    def summaries(self, query: list[float], count: int, session: str | None) -> DataFrame: ...
    def ensure_text_index(self) -> TextIndex: ...
    def close(self) -> None: ...


class VersionedStore:
    """A keyed table that is merged on read, with a text index that follows its writes in segments."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.held = MergeTable(spark, f"{path}/table", cluster=("project_name", "timestamp"))
        self._index = TextIndex(spark, f"{path}/text-index")

    def table(self) -> DataFrame:
        return self.held.read()

    def append(self, batch: DataFrame) -> None:
        self.upsert(batch)

    def upsert(self, batch: DataFrame) -> None:
        self.held.upsert(batch)
        if self._index.exists():  # the rows of the batch as they are in the table now, so of equal ids the last
            self._index.add(self.table().join(batch.select("id").distinct(), "id", "left_semi"))
        if self.held.due():
            self.optimise()

    def optimise(self) -> Merged:
        """Fold small writes in and drop what no recent version names."""
        done = self.held.merge()
        self.held.vacuum()
        if self._index.exists():
            self._index.vacuum()
        return done

    def _delete(self, rows: DataFrame) -> int:
        ids = rows.select("id")
        n = ids.count()
        if n:
            if self._index.exists():
                self._index.remove(ids)
            self.held.delete(ids)
        return n

    def delete_machine(self, machine: str) -> int:
        return self._delete(self.table().where(F.col("machine_id") == machine)) if machine else 0

    def clear(self) -> int:
        return self._delete(self.table())

    def by_id(self, chunk_id: str) -> DataFrame:
        return store.by_id(self.table(), chunk_id)

    def waiting(self, prefix: str, limit: int) -> DataFrame:
        return store.waiting(self.table(), prefix, limit)

    def backfill(self, embed: store.Embed) -> None:
        """Only chunks that get a vector are written."""
        found = store.filled(self.table().where("vector IS NULL"), embed).where("vector IS NOT NULL")
        self.held.upsert(found.hint("rebalance"))  # files of a good size, not one a shard

    def statistics(self) -> DataFrame:
        return store.statistics(self.table())

    def positions(self) -> DataFrame:
        return self.table().groupBy("source_file").agg(F.max("source_line").alias("position"))

    def vector_search(self, query, limit=10, filters=search.Filters()) -> DataFrame:
        return search.vector_search(self.table(), query, limit, filters)

    def text_search(self, question, limit=10, filters=search.Filters()) -> DataFrame:
        return search.text_search(self.table(), question, limit, filters, self.ensure_text_index())

    def hybrid_search(self, question, query, limit=10, filters=search.Filters()) -> DataFrame:
        return search.hybrid_search(self.table(), question, query, limit, filters, index=self.ensure_text_index())

    def file_changes(self, query, limit=10, path=None, operation=None) -> DataFrame:
        return search.file_change_search(self.table(), query, limit, path, operation)

    def summaries(self, query, count=5, session=None) -> DataFrame:
        return search.session_summaries(self.table(), query, count, session)

    def ensure_text_index(self) -> TextIndex:
        if not self._index.exists():
            self._index.build(self.table())
        return self._index

    def close(self) -> None:
        """Nothing is held open."""


class ScratchStore(VersionedStore):
    """A store that starts empty in the shared folder and goes when it is closed."""

    def __init__(self, spark: SparkSession, path: str = ""):
        super().__init__(spark, scratch(spark, "store"))

    def close(self) -> None:
        system, at = file_system(self.spark, self.path)
        system.delete(at, True)


STORES = {"versioned": VersionedStore, "scratch": ScratchStore}


def open_store(spark: SparkSession, kind: str, path: str = "") -> ChunkStore:
    """The store that a setting names."""
    if kind not in STORES:
        raise ValueError(f"no store {kind!r}; there are {', '.join(sorted(STORES))}")
    return STORES[kind](spark, path)
