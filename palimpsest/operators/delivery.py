"""Delivery rules between a machine's logs and the store, as aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunking import paired, safe_interval


def expanded(entries: DataFrame, intervals: DataFrame) -> DataFrame:
    """Units (file, user_line, line) that intervals (session_id, start_exclusive, end_inclusive) hand on, and where each then ends.

    The end is drawn back before a pair that crosses it and before a user that still waits
    there, so consecutive intervals, each from the safe end of the one before, hand on every
    pair once and whole. A pair that crosses the start is read from its user on. An
    interval that would go back (its end before its start) gives no unit but one row
    with the reason in ``error``.
    """
    back = F.col("end_inclusive") < F.col("start_exclusive")
    safe = safe_interval(entries, intervals.where(~back))
    pairs = paired(entries).select("session_id", "user_line", F.col("assistant_line").alias("line"))
    read = safe.join(pairs, "session_id").where((F.col("line") > F.col("start_exclusive")) & (F.col("line") <= F.col("safe_end")))
    no_line, no_text = F.lit(None).cast("long"), F.lit(None).cast("string")
    told = intervals.where(back).select(F.col("session_id").alias("file"), no_line.alias("user_line"), no_line.alias("line"), no_line.alias("safe_end"), F.lit("regressive boundary").alias("error"))
    return read.select(F.col("session_id").alias("file"), "user_line", "line", "safe_end", no_text.alias("error")).unionByName(told)


def delivered(records: DataFrame) -> DataFrame:
    """``records`` (file, seq, outcome of ok, blocked or down) with delivered.

    Records of a file go in order, and a blocked one stops its own file only; when
    the server is down everything stops. Two small aggregates say where.
    """
    blocked = records.where("outcome = 'blocked'").groupBy("file").agg(F.min("seq").alias("blocked_at"))
    down = records.where("outcome = 'down'").agg(F.min("seq").alias("down_at"))  # one row
    placed = records.join(blocked, "file", "left").join(F.broadcast(down))
    before = lambda c: F.coalesce(F.col("seq") < F.col(c), F.lit(True))
    return placed.withColumn("delivered", before("blocked_at") & before("down_at")).drop("blocked_at", "down_at")


def acknowledged(uploads: DataFrame) -> DataFrame:
    """Counts of an upload (n, received, embedded, stored) with acked: all of it or nothing."""
    return uploads.withColumn("acked", (F.col("received") == F.col("n")) & (F.col("embedded") == F.col("n")) & (F.col("stored") == F.col("n")))


def advanced(cursors: DataFrame, uploads: DataFrame) -> DataFrame:
    """Positions (file, position) after uploads (file, end, acked): only what was acknowledged moves them, and never back."""
    top = uploads.where("acked").groupBy("file").agg(F.max("end").alias("end"))
    return cursors.join(top, "file", "left").select("file", F.greatest("position", F.coalesce("end", "position")).alias("position"))
