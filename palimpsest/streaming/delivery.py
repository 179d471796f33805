"""Delivery on streams: records of a file in order with retries, and uploads that count as a whole or not at all."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import store
from ..operators.mergetable import MergeTable
from ..operators.ordered import saved

#: ok: delivered. blocked: this file waits and is tried again. down: nothing can be delivered now, which is no failed try.
Send = Callable[[str, int, int], str]
#: Records that wait, tries of the first of them, and the last record delivered.
_STATE = "pending array<bigint>, tries int, upto long"
_SENT = "file string, seq long, tries int"


def ordered_delivery(records: DataFrame, send: Send, retry_ms: int) -> DataFrame:
    """Deliveries (file, seq, tries) of a stream of records (file, seq), each file in order.

    The state of a file is what waits. A record that is blocked stops its own file; a timer
    tries it again, with or without new records. A record that is sent again changes nothing.
    """

    def deliver(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, tries, upto = state.get if state.exists else ([], 0, -1)
        waiting = set(pending)
        for batch in batches:
            waiting.update(int(s) for s in batch["seq"] if s > upto)
        pending, out = sorted(waiting), []
        while pending:
            told = send(key[0], pending[0], tries + 1)
            if told == "ok":
                upto = pending.pop(0)
                out.append((key[0], upto, tries + 1))
                tries = 0
                continue
            tries += told == "blocked"
            break
        state.update((pending, tries, upto))
        if pending:
            state.setTimeoutDuration(retry_ms)
        yield pd.DataFrame(out, columns=["file", "seq", "tries"])

    return records.groupBy("file").applyInPandasWithState(deliver, _SENT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def deliver_to(records: DataFrame, target: str, checkpoint: str, send: Send, retry_ms: int = 200, idle: int = 3, most_seconds: float = 900, partitions: int | None = None) -> None:
    """Run until ``idle`` rounds of timers have passed with neither a new record nor a delivery; a restart goes on from the checkpoint.

    ``partitions`` of the state are fixed by the first run; by default they are those of any shuffle.
    """
    spark = records.sparkSession
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    sent = ordered_delivery(records, send, retry_ms).observe("delivery", F.count(F.lit(1)).alias("sent")).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions or shuffle))
    try:
        query = sent.trigger(processingTime=f"{2 * retry_ms} milliseconds").start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    began = time.monotonic()
    try:
        while query.isActive:
            if time.monotonic() - began > most_seconds:
                raise TimeoutError(f"records are still delivered after {most_seconds} seconds")
            seen = [p for p in query.recentProgress if p["batchId"] >= 0 and p["durationMs"].get("addBatch")]
            if len(seen) >= idle and all(p["numInputRows"] == 0 and not p.observedMetrics["delivery"]["sent"] for p in seen[-idle:]):
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    if query.exception() is not None:
        raise query.exception()


def upload_tables(spark: SparkSession, target: str) -> tuple[MergeTable, MergeTable]:
    """Stored chunks, and the position up to which each file is acknowledged; both change in one version."""
    return MergeTable(spark, target, ("id",)), MergeTable(spark, target, ("file",), ("position",), side="cursors")


def store_uploads(batch: DataFrame, target: str, embed: store.Embed, number: int | None = None) -> bool:
    """Store the uploads of a batch (upload, file, end, n, id, content) that are whole, and move their files' positions.

    An upload counts when as many chunks were received, embedded and stored as it says
    (n); of any other upload nothing is stored and its file stays where it is. Chunks and
    positions come into force in one version, so a run that dies in between leaves
    neither. A batch that is sent again changes nothing.
    """
    spark = batch.sparkSession
    chunks, cursors = upload_tables(spark, target)
    if number is not None and number <= chunks.version()["batch"]:
        return False
    rows = saved(batch, "uploaded")
    vectors = rows.select("id", "content").mapInPandas(store.embed_batches(embed, retries=0, wait=0, some=False), "id string, vector array<float>")
    embedded = saved(rows.join(vectors, "id", "left"), "embedded")
    counts = embedded.groupBy("upload", "file").agg(F.max("end").alias("end"), F.max("n").alias("n"), F.count(F.lit(1)).alias("received"), F.count("vector").alias("embedded"))
    good = saved(counts.where("received = n AND embedded = n"), "whole-uploads")
    expected = good.agg(F.sum("n"), F.count_distinct("file")).first()
    whole = embedded.join(good.select("upload", "file"), ["upload", "file"], "left_semi").drop("end", "n")
    positions = good.groupBy("file").agg(F.max("end").alias("position"))
    return MergeTable.write_together([(chunks, whole), (cursors, positions)], number, whole=[expected[0] or 0, expected[1]])


def uploads_to(uploads: DataFrame, target: str, checkpoint: str, embed: store.Embed) -> None:
    """Store every micro-batch of whole uploads until the input is used up."""

    def write(batch: DataFrame, n: int) -> None:
        store_uploads(batch, target, embed, n)

    query = uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
