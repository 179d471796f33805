"""File operations named by the tool calls of a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

_CALL = "array<struct<name: string, args: struct<file_path: string, path: string, patch: string, command: string, CommandLine: string>>>"


def tool_operations(calls: Column) -> Column:
    """Of every call: its path, or the headers of its patch, or what its shell command shows."""

    def operations(call: Column) -> Column:
        args = call["args"]
        path = F.coalesce(args["file_path"], args["path"])
        kind = F.when(F.lower(call["name"]).contains("edit"), "edit").otherwise("write")
        named = F.struct(path.alias("file_path"), kind.alias("operation"), F.lit("File change").alias("summary"))
        shell = tx.shell_operation(F.coalesce(args["command"], args["CommandLine"], F.lit("")))
        return F.when(path.isNotNull(), F.array(named)).when(args["patch"].isNotNull(), tx.patch_operations(args["patch"])).otherwise(F.array_compact(F.array(shell)))

    return F.array_distinct(F.flatten(F.transform(F.from_json(calls, _CALL), operations)))
