"""Streaming jobs: pairs, upserts, heartbeats and cursors, each run until its input is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.mergetable import MergeTable
from ..paths import scratch
from .pairing import streamed_pairs


#: Rows in order of their arrival.
ARRIVED = ("__batch", "__seq")


def _drained(stream, checkpoint: str):
    """Start with AvailableNow and wait; a restart goes on from the checkpoint."""
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drained(stream, checkpoint: str) -> int:
    """Run a stream of bounded batches until a run changes no offset; how many runs had rows or offsets of their own.

    For sources that PySpark gives a single batch under AvailableNow.
    """
    runs, last = 0, None
    while True:
        query = _drained(stream, checkpoint)
        ends = [s["endOffset"] for s in (query.lastProgress or {"sources": []})["sources"]]
        if not ends or ends == last:
            return runs
        runs, last = runs + 1, ends


def pairs_to(entries: DataFrame, target: str, checkpoint: str) -> None:
    """Append the pairs of a stream of entries to a Parquet table."""
    _drained(streamed_pairs(entries).writeStream.outputMode("append").format("parquet").option("path", target), checkpoint)


def _merged_to(stream: DataFrame, table: MergeTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Write every micro-batch as a delta of the table; merge when the deltas have grown enough.

    A batch costs its own rows. A batch repeated after a failure is known by its number
    and changes nothing.
    """

    def write(batch: DataFrame, n: int) -> None:
        held = MergeTable(batch.sparkSession, table.path, tuple(table.keys), tuple(table.order), tuple(table.cluster), table.target)
        held.upsert(prepare(batch), number=n)
        if held.due():
            held.merge()
            held.vacuum()

    _drained(stream.writeStream.foreachBatch(write), checkpoint)


def upsert_to(rows: DataFrame, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order: tuple[str, ...] = ARRIVED) -> None:
    """Upsert every micro-batch by id; of equal ids in a batch the last by ``seq`` wins, and a later batch wins over an earlier one.

    ``order`` names columns that say which row is newer whatever batch brings it: files of a folder come in order of
    their times, which need not be that of their rows.
    """
    _merged_to(rows, MergeTable(rows.sparkSession, target, order=order), checkpoint, prepare)


def latest_version(spark: SparkSession, target: str, keys: tuple[str, ...] = ("id",), order: tuple[str, ...] = ARRIVED) -> DataFrame:
    """The table that a job keeps, as of its last complete batch."""
    return MergeTable(spark, target, keys, order).read()


#: Keys and order of the tables of heartbeats and of cursors.
HEARTBEATS, CURSORS = (("machine",), ("ts", "event_id")), (("machine", "file"), ("position",))


def heartbeats_to(events: DataFrame, target: str, checkpoint: str) -> None:
    """The last heartbeat of each machine (machine, ts, event_id, kind)."""
    _merged_to(events, MergeTable(events.sparkSession, target, *HEARTBEATS), checkpoint)


def cursors_to(positions: DataFrame, target: str, checkpoint: str) -> None:
    """Positions (machine, file, position) that never go back."""
    _merged_to(positions, MergeTable(positions.sparkSession, target, *CURSORS), checkpoint)


def periodic(spark: SparkSession, work: Callable[[], None], seconds: float, times: int, checkpoint: str) -> int:
    """Run ``work`` every so many seconds, ``times`` times; how often it succeeded. A failure waits for the next turn; if no turn succeeds, the last failure is raised."""
    done, turns, failures = [], [], []

    def turn(batch: DataFrame, n: int) -> None:
        if len(turns) < times:
            try:
                work()
                done.append(n)
            except Exception as failure:  # noqa: BLE001  a job that fails now is tried again next time
                failures.append(failure)
            turns.append(n)  # after the work: the query stops when all turns are over

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = ticks.writeStream.foreachBatch(turn).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
    while len(turns) < times and query.isActive:
        query.awaitTermination(0.2)
    query.stop()
    if failures and not done:
        raise failures[-1]
    return len(done)


def places(spark: SparkSession, name: str) -> tuple[str, str]:
    """Target and checkpoint folders of a job."""
    return scratch(spark, name), scratch(spark, f"{name}-offsets")
