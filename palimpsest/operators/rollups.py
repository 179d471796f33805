"""Rollups of the control plane: cursors, queues, health, clients, rates, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .ordered import saved

#: Metric names, kinds and help texts (fixed values).
METRICS = [
    ("mcp_server_uptime_seconds", "gauge", "Server uptime in seconds"), ("mcp_chunks_total", "counter", "Total chunks indexed"),
    ("mcp_indexing_files_pending", "gauge", "Number of files pending indexing"), ("mcp_indexing_files_failed", "gauge", "Number of failed file indexing attempts"),
    ("mcp_memory_usage_bytes", "gauge", "Memory usage in bytes"), ("mcp_cpu_percent", "gauge", "CPU usage percentage"), ("mcp_queries_total", "counter", "Total number of queries processed"),
    ("mcp_query_duration_seconds_avg", "gauge", "Average query duration in seconds"), ("mcp_cache_hits_total", "counter", "Cache hit count"), ("mcp_cache_misses_total", "counter", "Cache miss count"),
    ("mcp_cache_size", "gauge", "Current cache size"), ("mcp_health_status", "gauge", "Health status (1=healthy, 0.5=degraded, 0=unhealthy)"),
]
HEARTBEAT_US, STALE_DAYS, STALE_UPLOAD_HOURS = 300_000_000, 7, 72


def monotone(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """A cursor never goes back: the running maximum."""
    seen = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.max(column).over(seen))


def rolling_mean(rows: DataFrame, keys: list[str], order: str, column: str, last: int) -> DataFrame:
    return rows.withColumn("mean", F.avg(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - last, 0)))


def latest(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key (a ring)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def queue(rows: DataFrame) -> DataFrame:
    """Oldest record, retries, retried and blocked (three retries) records of each machine."""
    r = F.col("retry_count")
    return rows.groupBy("machine").agg(F.min("created_at").alias("oldest"), F.sum(r).alias("retries"), F.count_if(r > 0).alias("retried"), F.count_if(r >= 3).alias("blocked"))


def health(check: Column) -> Column:
    return F.when(F.bool_and(check == "ok"), "healthy").when(F.bool_or(check == "error"), "unhealthy").otherwise("degraded")


def rates(samples: DataFrame, keys: list[str], order: list[str], awaiting: Column) -> DataFrame:
    """Embedded a minute since the last sample (at least a second ago), and the seconds left at that rate."""
    w = Window.partitionBy(*keys).orderBy(*order)
    us = F.unix_micros("ts")
    gained, took = F.col("embedded") - F.lag("embedded").over(w), us - F.lag(us).over(w)
    rate = F.when((took >= 1_000_000) & (gained > 0), gained / (took / 1_000_000.0) * 60)
    return samples.withColumn("rate", rate).withColumn("eta", awaiting / (F.col("rate") / 60))


def stale(created: Column, now: Column) -> Column:
    """Records older than 72 hours are counted; none is deleted."""
    return F.count_if(F.unix_micros(now) - F.unix_micros(created) >= STALE_UPLOAD_HOURS * 3_600_000_000)


def heads(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first waiting record of each file: only it may be delivered."""
    return rows.withColumn("__h", F.min(order).over(Window.partitionBy(*keys))).where(F.col(order) == F.col("__h")).drop("__h")


def last_heartbeats(rows: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("h"))
    return last.select(key, *[F.col(f"h.{c}").alias(c) for c in columns])


def client_labels(clients: DataFrame, now: Column) -> DataFrame:
    """Label by silence and state; stale after seven days."""
    silence = F.unix_micros(now) - F.unix_micros("seen")
    label = F.when(F.coalesce(silence > HEARTBEAT_US, F.lit(True)), "Disconnected").when(F.col("kind") == "error", "Degraded").otherwise("OK")
    return clients.select("*", label.alias("label"), F.coalesce(silence > STALE_DAYS * 86_400_000_000, F.lit(False)).alias("stale"))


def placed(rows: DataFrame, order: list) -> DataFrame:
    """Number rows from 1 in an order: ranges of the sorted table are numbered apart, with the rows before each added.

    Spark finds the ranges from a sample, another one each time it deals the rows, so the dealt rows are
    written and both the counts and the numbers are taken from what was written.
    """
    ranged = rows.sparkSession
    parts = int(ranged.conf.get("spark.sql.shuffle.partitions"))
    split = saved(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "places")
    counts = split.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a partition
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__b"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return split.join(F.broadcast(before), "__part").withColumn("place", F.col("__b") + nth).drop("__part", "__b")


def numeric_section(section: Column) -> Column:
    """The allowed numeric entries of a heartbeat section."""
    allowed = F.array(*map(F.lit, fixed.NUMERIC_KEYS))
    return F.map_filter(section, lambda k, v: F.array_contains(allowed, k) & v.try_cast("double").isNotNull())


def text_section(section: Column) -> Column:
    """The allowed text entries; other characters become underscores."""
    allowed = F.array(*map(F.lit, fixed.TEXT_KEYS))
    plain = lambda v: F.when(v.rlike("^[A-Za-z0-9_.:+-]{1,256}$"), v).otherwise(F.substring(F.regexp_replace(v, "[^A-Za-z0-9_.:-]+", "_"), 1, 120))
    return F.transform_values(F.map_filter(section, lambda k, v: F.array_contains(allowed, k) & v.isNotNull()), lambda k, v: plain(v))


def gaps(local: DataFrame, server: DataFrame, pending: DataFrame) -> DataFrame:
    """Intervals that the server misses, but for files with uploads pending."""
    joined = local.join(server, "file", "left").join(pending, "file", "left_anti")
    start = F.coalesce("server", F.lit(0).cast("long"))
    return joined.where(F.col("local") > start).select("file", start.alias("start_exclusive"), F.col("local").alias("end_inclusive"))


def reindex_required(machines: DataFrame, acks: DataFrame) -> DataFrame:
    """Required unless the machine acknowledged the request as completed."""
    done = acks.groupBy("machine").agg(F.bool_or(F.col("status") == "completed").alias("done"))
    return machines.join(done, "machine", "left").select("machine", (~F.coalesce("done", F.lit(False))).alias("required"))


def exposition(status: DataFrame) -> DataFrame:
    """Metric texts from one status row; metrics without a column are left out."""
    told = []
    for name, kind, about in METRICS:
        if name not in status.columns:
            continue
        v = F.col(name)
        if name == "mcp_health_status":
            shown = F.when(v == "healthy", "1.0").when(v == "degraded", "0.5").otherwise("0.0")
        elif name == "mcp_query_duration_seconds_avg":
            shown = F.format_string("%.6f", v)
        else:
            shown = v.cast("string")
        told.append(F.struct(F.lit(name).alias("name"), F.concat(F.lit(f"# HELP {name} {about}\n# TYPE {name} {kind}\n{name} "), shown).alias("text")))
    return status.select(F.inline(F.array(*told)))


def server_status(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: chunks, vectors, queries and their mean latency, errors, health."""
    a = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.count("vector").alias("embedded"), F.count_distinct("session_id").alias("sessions"), F.lit(1).alias("k"))
    b = queries.agg(F.count(F.lit(1)).alias("queries_total"), F.avg("latency_ms").alias("avg_latency_ms"), F.count_if(F.col("kind") == "error").alias("errors"), health(F.when(F.col("kind") == "error", "degraded").otherwise("ok")).alias("status"), F.lit(1).alias("k"))
    return a.join(b, "k").drop("k")
