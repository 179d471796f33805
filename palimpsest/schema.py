"""Schemas and domains of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: One stored chunk of a conversation.
CHUNKS = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("content", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("chunk_type", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False), T.StructField("project_path", T.StringType(), False),
    T.StructField("project_name", T.StringType(), False), T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("user_uuid", T.StringType()), T.StructField("assistant_uuid", T.StringType()),
    T.StructField("file_path", T.StringType()), T.StructField("operation", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("source_file", T.StringType(), False), T.StructField("source_line", T.LongType(), False),
    T.StructField("parent_chunk_id", T.StringType()), T.StructField("child_chunk_ids", T.ArrayType(T.StringType())),
    T.StructField("machine_id", T.StringType()),
])

CHUNK_TYPES = ("turn", "file_change", "summary", "antigravity_history")
OPERATIONS = ("edit", "write", "delete", "move")

#: A message block of the primary log, its tool input reduced to the fields that matter.
BLOCK = "struct<type: string, text: string, id: string, name: string, content: string, file_path: string, old_string: string, new_string: string, command: string>"

RESULT_COLUMNS = ("id", "content", "chunk_type", "session_id", "project_path", "project_name", "timestamp", "file_path", "operation", "machine_id", "score")

#: Vector length by model name (fixed values); others have 768.
VECTOR_LENGTHS = {"bge-m3": 1024, "nomic-embed-text": 768, "all-minilm": 384, "mxbai-embed-large": 1024, "snowflake-arctic-embed": 1024, "gemini-embedding-001": 3072}


def vector_length(model: str, explicit: int | None = None) -> int:
    return explicit or VECTOR_LENGTHS.get(model.split(":")[0], 768)
