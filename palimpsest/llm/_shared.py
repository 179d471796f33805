"""Helpers of the training-data operators: the shared folder, row keys, hot groups."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with more rows than this share of all rows counts as hot, so at most
#: HOT_GROUPS groups can be hot and the table of hot groups may be broadcast.
HOT_GROUPS = 4000
#: Groups of at most so many rows never count as hot.
HOT_LEAST = 100


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode (tests) one is chosen where that setting is unset; on a
    cluster a machine-local folder would split tables over machines.
    """
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "/tmp/palimpsest-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def save(df: DataFrame, name: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(compression="zstd", **options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path).select([col(c) for c in df.columns])
    back.saved_at = path
    return back


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of the shared store; none if it does not exist."""
    system, target = _file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def discard(*saved: DataFrame) -> None:
    """Delete what :func:`save` wrote, once nothing reads it any more."""
    for df in saved:
        path = getattr(df, "saved_at", None)
        if path:
            remove(df.sparkSession, path)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` of ``groups``, safe for hot keys.

    ``size`` holds how many of the ``total`` rows have the key. Keys with more
    than max(HOT_LEAST, total / HOT_GROUPS) rows are broadcast (there are at
    most HOT_GROUPS of them); the others meet in a shuffle, where each of them is
    small. ``key`` must not be null.
    """
    limit = max(HOT_LEAST, total // HOT_GROUPS)
    hot = groups.where(F.col(size) > limit)
    cold = groups.where(F.col(size) <= limit)
    warm_rows = rows.join(F.broadcast(hot), key, "inner")
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "inner")
    return warm_rows.unionByName(cold_rows)


def join_dealt(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, deal: str) -> DataFrame:
    """As :func:`join_groups`, reading ``rows`` once: for rows that are dear to make again.

    Rows of a hot key are dealt to parts of about max(HOT_LEAST, total / HOT_GROUPS)
    rows by a hash of ``deal``, and its group goes to each part. Only keys and
    numbers of parts of hot keys are broadcast, at most HOT_GROUPS rows.
    """
    limit = max(HOT_LEAST, total // HOT_GROUPS)
    parts = F.when(F.col(size) > limit, F.ceil(F.col(size) / limit)).otherwise(1).cast("int")
    hot = groups.where(F.col(size) > limit).select(key, parts.alias("parts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("part", F.pmod(F.xxhash64(deal), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    each = groups.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(each, [key, "part"]).drop("part")
