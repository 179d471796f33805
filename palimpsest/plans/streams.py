"""Streaming jobs over the given tables, read as file streams until they are used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from . import tables
from .registry import query

T = tables


def _stream(spark, sf_dir, name):
    """A table as a file stream, be it one file or a folder of files."""
    schema = T.table(spark, sf_dir, name).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("stm03_stm05_stm06_streamed_pairs", f"WITH {T.ENTRIES_SQL}, x AS (SELECT *, lag(role) OVER w AS prev, lag(line) OVER w AS uline FROM entries WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY line)) SELECT session_id, uline AS user_line, line AS assistant_line FROM x WHERE role = 'assistant' AND prev = 'user'")
def stm06(spark, sf_dir):
    c = _stream(spark, sf_dir, "conversations")
    entries = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), (F.col("turn") + 1).cast("long").alias("line"), "role", "text", F.lit("p").alias("project_name"), F.timestamp_micros(F.col("turn").cast("long")).alias("ts"))
    target, offsets = jobs.places(spark, "pairs")
    jobs.pairs_to(entries, target, offsets)
    return spark.read.parquet(target).select("session_id", "user_line", "assistant_line")


@query("stm04_snk02_streamed_upserts", "SELECT doc_id % 300 AS id, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def stm04(spark, sf_dir):
    d = _stream(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("id"), "doc_id")
    target, offsets = jobs.places(spark, "upserts")
    jobs.upsert_to(d, target, offsets, order=("doc_id",))
    return jobs.latest_version(spark, target, order=("doc_id",))


def _machine():
    return F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string")).alias("machine")


@query("stm17_streamed_heartbeats", "SELECT 'm' || (user_id % 20) AS machine, max_by(event_type, struct_pack(t := ts, e := event_id)) AS kind FROM events GROUP BY 1")
def stm17(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(_machine(), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind"))
    target, offsets = jobs.places(spark, "heartbeats")
    jobs.heartbeats_to(e, target, offsets)
    return jobs.latest_version(spark, target, *jobs.HEARTBEATS).select("machine", "kind")


@query("stm19_streamed_cursors", "SELECT 'm' || (user_id % 20) AS machine, event_type AS file, max(event_id) AS position FROM events GROUP BY ALL")
def stm19(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select(_machine(), F.col("event_type").alias("file"), F.col("event_id").alias("position"))
    target, offsets = jobs.places(spark, "cursors")
    jobs.cursors_to(e, target, offsets)
    return jobs.latest_version(spark, target, *jobs.CURSORS)
