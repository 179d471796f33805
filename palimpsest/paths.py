"""The folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only in local mode (tests) one is chosen where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/palimpsest-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The store that holds a path, and the path, as Hadoop knows them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def stored(spark: SparkSession, path: str) -> bool:
    system, target = file_system(spark, path)
    return system.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    system, target = file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []


def state_of(spark: SparkSession, path: str) -> str:
    """What tells one state of a file or folder from another: its bytes, files and time of change."""
    system, target = file_system(spark, path)
    summary = system.getContentSummary(target)
    return f"{summary.getLength()}-{summary.getFileCount()}-{system.getFileStatus(target).getModificationTime()}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file."""
    system, target = file_system(spark, path)
    out = system.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    system, target = file_system(spark, path)
    data = system.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode()
    finally:
        data.close()
