"""From log entries to chunks: pairing, accumulation, parts, ids, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import packed, running

#: Entries: session_id, line, role, text, project_name, ts; optionally is_summary.


def _talk(entries: DataFrame) -> DataFrame:
    """Users and assistants; compact summaries and other roles are transparent."""
    rows = entries.where(F.col("role").isin("user", "assistant"))
    return rows.where(~F.coalesce("is_summary", F.lit(False))) if "is_summary" in entries.columns else rows


def _with_previous(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("line")
    return rows.select("*", *[F.lag(c).over(order).alias(f"user_{c}") for c in ("role", "text", "line", "ts")])


def paired(entries: DataFrame) -> DataFrame:
    """Each assistant entry with the user entry right before it.

    Every assistant clears the waiting user and every user replaces it, so looking
    one entry back is the whole rule.
    """
    rows = _with_previous(_talk(entries)).where((F.col("role") == "assistant") & (F.col("user_role") == "user"))
    return rows.select(
        "session_id", "project_name", "user_line", F.col("line").alias("assistant_line"), F.trim("user_text").alias("user_text"), F.trim("text").alias("assistant_text"),
        F.coalesce("ts", "user_ts", F.timestamp_micros("line")).alias("ts"),
    )


def unpaired(entries: DataFrame) -> DataFrame:
    """Assistant entries without a user: only their file changes are kept."""
    return _with_previous(_talk(entries)).where((F.col("role") == "assistant") & (F.coalesce("user_role", F.lit("")) != "user"))


def paired_exports(entries: DataFrame) -> DataFrame:
    """Export formats: blank texts do not count, and any reply closes a turn."""
    spoken = entries.where(F.trim("text") != "").withColumn("role", F.when(F.col("role") == "user", "user").otherwise("assistant"))
    return paired(spoken)


def accumulated(entries: DataFrame) -> DataFrame:
    """One row for each user entry with all replies until the next; replies before any user are left out."""
    order = Window.partitionBy("session_id").orderBy("line")
    rows = entries.where(F.trim("text") != "").withColumn("turn", F.sum((F.col("role") == "user").cast("long")).over(order)).where("turn > 0")
    reply = F.when(F.col("role") != "user", F.struct("line", "text"))
    turns = rows.groupBy("session_id", "turn").agg(
        F.min("line").alias("line"), F.first("project_name").alias("project_name"), F.min(F.when(F.col("role") == "user", F.col("text"))).alias("user_text"),
        F.array_sort(F.collect_list(reply)).alias("r"), F.max("ts").alias("ts"),
    )
    texts = F.transform("r", lambda x: x["text"])
    return turns.select("session_id", "turn", "line", "project_name", "user_text", F.array_join(texts, "\n").alias("replies"), F.size("r").cast("long").alias("n_replies"), "ts")


def carried(entries: DataFrame, column: str) -> DataFrame:
    """The last value seen so far in a session."""
    order = Window.partitionBy("session_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn(column, F.last(column, ignorenulls=True).over(order))


def with_parts(rows: DataFrame) -> DataFrame:
    """Split long contents; add part, parts, id, base_id and parent_chunk_id.

    Rows hold content, session_id and time (the text that goes into the hash).
    """
    base = rows.withColumn("base_id", tx.chunk_id(F.col("content"), F.col("session_id"), F.col("time")))
    short = base.where(F.length("content") <= 8000).withColumn("__p", F.array("content"))
    long = base.where(F.length("content") > 8000).withColumn("__p", tx.split_parts("content"))  # only these reach Python
    split = short.unionByName(long).select("*", F.size("__p").alias("parts"), F.posexplode("__p").alias("__i", "__t")).drop("__p", "content")
    many, part = F.col("parts") > 1, F.col("__i") + 1
    content = F.when(many, F.concat(F.lit("[Part "), part.cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit("] "), F.col("__t"))).otherwise(F.col("__t"))
    split = split.withColumns({"part": part, "content": content})
    salted = F.concat("time", F.lit("_part"), F.col("part").cast("string"))
    return split.withColumns({
        "id": F.when(many, tx.chunk_id(F.col("content"), F.col("session_id"), salted)).otherwise(F.col("base_id")),
        "parent_chunk_id": F.when(many & (F.col("part") > 1), F.col("base_id")),
    }).drop("__i", "__t")


def turn_chunks(pairs: DataFrame) -> DataFrame:
    """Chunks of paired turns; pairs without any text give none."""
    some = pairs.where((F.col("user_text") != "") | (F.col("assistant_text") != ""))
    rows = some.withColumns({"content": tx.turn(F.col("project_name"), F.col("user_text"), F.col("assistant_text")), "time": tx.time_text(F.col("ts")), "chunk_type": F.lit("turn")})
    return with_parts(rows.drop("user_text", "assistant_text"))


def file_change_chunks(turns: DataFrame) -> DataFrame:
    """One chunk for each file operation of a turn (ops: array of file_path, operation, summary, tool_id)."""
    rows = turns.select("*", F.posexplode("ops").alias("nth", "op")).drop("ops")
    salt = F.coalesce(F.nullif(F.col("op.tool_id"), F.lit("")), F.concat(F.lit("idx"), F.col("nth").cast("string")))
    content = tx.file_change(F.col("project_name"), F.col("op.file_path"), F.col("op.operation"), F.col("op.summary"), F.col("user_text"))
    rows = rows.withColumn("content", content)
    return rows.withColumns({
        "id": tx.chunk_id(F.col("content"), F.col("session_id"), F.concat("time", "op.file_path", salt)), "chunk_type": F.lit("file_change"),
        "file_path": F.col("op.file_path"), "operation": F.col("op.operation"),
    }).drop("op", "nth", "user_text")


def linked(turns: DataFrame, changes: DataFrame) -> DataFrame:
    """First parts of turns with the ids of their file changes."""
    children = changes.groupBy("session_id", "user_line").agg(F.array_sort(F.collect_list("change_id")).alias("child_chunk_ids"))
    joined = turns.join(children, ["session_id", "user_line"], "left")
    return joined.withColumn("child_chunk_ids", F.coalesce("child_chunk_ids", F.array().cast("array<string>")))


def safe_interval(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Widen (start_exclusive, end_inclusive] of a session so that no pair is split.

    A pair across the start is read from its user on; a pair across the end, or a
    user still waiting there, is left for later.
    """
    pairs = paired(entries).select("session_id", "user_line", F.col("assistant_line").alias("reply"))
    talk = _talk(entries).join(wanted.select("session_id", F.col("end_inclusive").alias("e")).distinct(), "session_id")
    last = talk.where("line <= e").groupBy("session_id", F.col("e").alias("end_inclusive")).agg(F.max_by("role", "line").alias("role"), F.max("line").alias("line"))
    before = F.greatest(F.col("user_line") - 1, F.lit(0))
    s, e = F.col("start_exclusive"), F.col("end_inclusive")
    joined = wanted.join(pairs, "session_id", "left").groupBy("session_id", "start_exclusive", "end_inclusive").agg(
        F.min(F.when((F.col("user_line") <= s) & (s < F.col("reply")), before)).alias("low"), F.min(F.when((F.col("user_line") <= e) & (e < F.col("reply")), before)).alias("high"))
    joined = joined.join(last, ["session_id", "end_inclusive"], "left")
    trailing = F.when(F.col("role") == "user", F.greatest(F.col("line") - 1, F.lit(0)))
    start = F.least(s, F.coalesce("low", s))
    end = F.least(e, F.coalesce("high", e), F.coalesce(trailing, e))
    return joined.select("session_id", "start_exclusive", "end_inclusive", start.alias("safe_start"), F.greatest(start, end).alias("safe_end"))


def packed_uploads(chunks: DataFrame, most_rows: int = 500, most_bytes: int = 1 << 20) -> DataFrame:
    """Upload records of chunks (source_file, line, seq, bytes): consecutive chunks of one consumed line, within both bounds.

    A record never spans lines. The position of a file moves to a line with the line's
    last record only; records before it leave the position at the line before. Lines are
    packed apart from each other, so a file with a million of them is shared out.
    """
    records = packed(chunks, ["source_file", "line"], [F.col("seq")], "bytes", most_rows, most_bytes)
    lines = running(chunks.select("source_file", "line").distinct(), ["source_file"], [F.col("line")], {"start_position": ("max", F.col("line"))}, own=False)
    told = records.join(lines.withColumn("start_position", F.coalesce("start_position", F.lit(0))), ["source_file", "line"])
    position = F.when(F.col("last"), F.col("line")).otherwise(F.col("start_position"))
    return told.select("source_file", "line", "record", "rows", F.col("size").alias("bytes"), "start_position", position.alias("position"), F.col("last").alias("final_fragment"), "oversize")
