"""Which files of a folder a source reads, and uploads left in a landing folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

#: The paths that each source reads.
PATHS = {
    "primary": r"\.jsonl$",
    "codex": r"\.jsonl$",
    "gemini": r"(^|/)logs\.json$|(^|/)chats/[^/]*\.json$",
    "antigravity": r"(^|/)conversations/[^/]*\.pb$|(^|/)logs/transcript_full\.jsonl$",
    "chatgpt": r"(^|/)conversations\.json$",
    "claude_app": r"(^|/)conversations\.json$",
}
UPLOAD = "upload_id string, machine_id string, chunks array<struct<id: string, content: string, source_file: string, source_line: long>>"


def accepts(source: str, path: Column) -> Column:
    return path.rlike(PATHS[source])


def inside(path: Column, root: str) -> Column:
    """Whether a path lies below a folder by its letters alone: no step up, and the folder before it."""
    return path.startswith(root.rstrip("/") + "/") & ~F.exists(F.split(path, "/"), lambda p: p == "..")


def discovered(spark: SparkSession, root: str, source: str) -> DataFrame:
    """path, length and modification time of the files below ``root`` that the source reads; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    return found.where(accepts(source, F.col("path")) & F.col("path").contains(root.rstrip("/") + "/"))


def with_fallback_time(rows: DataFrame, time: str, modified: Column) -> DataFrame:
    """Rows whose time is missing take the time their file was changed."""
    return rows.withColumn(time, F.coalesce(time, modified))


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of uploads, one JSON document a line: their chunks, with the reason where an upload is refused."""
    lines = spark.readStream.schema("value string").text(path)
    body = lines.select(F.octet_length("value").alias("bytes"), F.from_json("value", UPLOAD).alias("u"))
    reason = F.when(F.col("u.upload_id").isNull(), "not an upload").when(F.col("bytes") > fixed.UPLOAD_BYTES, "body too large").when(F.size("u.chunks") > fixed.MOST_UPLOADED, "too many chunks")
    return body.select("u.upload_id", "u.machine_id", reason.alias("refused"), F.explode_outer(F.when(reason.isNull(), F.col("u.chunks"))).alias("c")).select("upload_id", "machine_id", "refused", "c.*")
