"""Readers of conversation files: one row per file in, entries and rejects out.

A file is read as one immutable row (path, content); its line count, digest and
entries all come from those bytes. Lines end at ``\\n`` only. A bad row loses only
itself; unreadable files and bad UTF-8 fail the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import times
from ..schema import BLOCK

#: Fixed limits: characters of a line, levels of a JSON value, bytes of a file.
MOST_LINE, MOST_DEPTH = 512 * 1024, 50
#: File patterns of each source.
PATTERNS = {
    "primary": "*.jsonl", "codex": "*.jsonl", "gemini": "*.json", "antigravity": "transcript_full.jsonl", "antigravity_binary": "*.pb",
    "chatgpt": "conversations.json", "claude_app": "conversations.json",
}


def files(spark: SparkSession, root: str, source: str) -> DataFrame:
    """path, bytes and time of every file of a source below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PATTERNS[source]).load(root)
    rows = found.select("path", F.col("content").alias("bytes"), F.col("modificationTime").alias("changed"))
    wanted = {"gemini": r"(/logs\.json|/chats/[^/]+\.json)$", "antigravity": r"/logs/transcript_full\.jsonl$", "antigravity_binary": r"/conversations/[^/]+\.pb$"}
    return rows.where(F.col("path").rlike(wanted[source])) if source in wanted else rows


def text_of(rows: DataFrame) -> DataFrame:
    """Decode strictly: a file that is no UTF-8 fails the job."""
    good = F.is_valid_utf8(F.col("bytes").cast("string"))
    return rows.withColumn("content", F.when(good, F.col("bytes").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path")))).drop("bytes")


def lines(rows: DataFrame, start: int | Column = 0) -> DataFrame:
    """path, line (from 1) and text; blank and over-long lines and those up to ``start`` are left out."""
    every = rows.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    every = every.select("path", (F.col("n") + 1).cast("long").alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))
    return every.where((F.col("line") > start) & (F.trim("text") != "") & (F.length("text") <= MOST_LINE))


def line_count(content: Column) -> Column:
    """Physical lines: an unended last line counts, an empty one does not."""
    parts = F.split(content, "\n")
    return (F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)).cast("long")


def prefix_digest(content: Column, n: Column) -> Column:
    """SHA-256 of the first n lines with their ends."""
    parts = F.split(content, "\n")
    ended = F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    return F.sha2(F.array_join(F.slice(ended, 1, n), ""), 256)


@F.udf(T.IntegerType(), useArrow=True)
def json_depth(value: str) -> int:
    """Levels of a JSON text, by a scan outside of strings; no built-in function tells it."""
    depth = most = 0
    inside = escaped = False
    for c in value or "":
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def parsed(rows: DataFrame) -> DataFrame:
    """Add reason: why a line is refused, or null. Lines without 51 brackets cannot be too deep."""
    many = F.length("text") - F.length(F.regexp_replace("text", r"[\[{]", "")) > MOST_DEPTH
    shape = F.schema_of_variant(F.try_parse_json("text"))
    kind = F.get_json_object("text", "$.type")
    reason = (
        F.when(F.try_parse_json("text").isNull(), "invalid_json").when(~shape.startswith("OBJECT"), "not_an_object")
        .when(F.coalesce(kind, F.lit("")) == "", "no_type").when(F.when(many, json_depth("text")).otherwise(0) > MOST_DEPTH, "too_deep")
    )
    return rows.select("*", reason.alias("reason"))


_RAW = "struct<type: string, text: string, id: string, name: string, content: string, input: struct<file_path: string, old_string: string, new_string: string, command: string>>"


def primary_entries(rows: DataFrame) -> DataFrame:
    """Entries of the primary log: message blocks flattened to text, file operations beside it."""
    good = parsed(rows).where("reason IS NULL").drop("reason")
    at = lambda path: F.get_json_object("text", path)
    content = at("$.message.content")
    many = F.from_json(content, f"array<{_RAW}>")
    one = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "content", "file_path", "old_string", "new_string", "command")]))
    flat = F.transform(many, lambda b: F.struct(b["type"].alias("type"), b["text"].alias("text"), b["id"].alias("id"), F.coalesce(b["name"], F.lit("unknown")).alias("name"), b["content"].alias("content"),
                                                 b["input"]["file_path"].alias("file_path"), b["input"]["old_string"].alias("old_string"), b["input"]["new_string"].alias("new_string"), b["input"]["command"].alias("command")))
    listed = F.trim(content).startswith("[")
    blocks = F.when(listed, flat).otherwise(one).cast(f"array<{BLOCK}>")
    project = tx.project_path(F.element_at(F.split("path", "/"), -2))
    rows = good.select(
        F.col("path").alias("source_file"), "line", at("$.type").alias("role"), F.coalesce(at("$.isCompactSummary").cast("boolean"), F.lit(False)).alias("is_summary"),
        F.coalesce(at("$.sessionId"), F.lit("unknown")).alias("session_id"), project.alias("project_path"), tx.last_component(project).alias("project_name"),
        times.or_line(at("$.timestamp").try_cast("timestamp"), F.col("line")).alias("ts"), at("$.uuid").alias("uuid"), at("$.message.model").alias("model"), at("$.summary").alias("summary"), blocks.alias("blocks"),
    )
    return rows.select("*", F.coalesce(tx.message_text(F.col("blocks")), F.lit("")).alias("text"), tx.file_operations(F.col("blocks")).alias("ops")).drop("blocks")


def codex_entries(rows: DataFrame) -> DataFrame:
    """Events of a codex session: role, text and patch or shell operations."""
    good = parsed(rows).where("reason IS NULL")
    at = lambda path: F.get_json_object("text", path)
    kind, payload = at("$.type"), at("$.payload.type")
    items = F.from_json(at("$.payload.content"), "array<struct<type: string, text: string>>")
    told = F.array_join(F.transform(F.filter(items, lambda i: i["type"].isin("input_text", "output_text", "text") & (i["text"] != "")), lambda i: i["text"]), "\n")
    call = F.trim(F.concat(F.lit("[Tool call] "), F.coalesce(at("$.payload.name"), F.lit("unknown")), F.lit(" "), F.coalesce(at("$.payload.arguments"), F.lit(""))))
    summary = F.array_join(F.from_json(at("$.payload.summary"), "array<string>"), " ")
    text = (
        F.when(payload == "message", told).when(payload == "function_call", call)
        .when(payload == "function_call_output", F.trim(F.concat(F.lit("[Tool output] "), F.coalesce(at("$.payload.output"), F.lit("")))))
        .when(payload == "web_search_call", F.trim(F.concat(F.lit("[Web search] "), F.coalesce(at("$.payload.action.query"), F.lit("")))))
        .when(payload == "reasoning", F.trim(F.concat(F.lit("[Reasoning summary] "), F.coalesce(summary, F.lit(""))))).when(payload == "ghost_snapshot", "[Ghost snapshot captured]")
        .when(kind == "event_msg", at("$.payload.message"))
    )
    shell = tx.shell_operation(F.get_json_object(at("$.payload.arguments"), "$.command"))
    named = at("$.payload.name")
    operation = "array<struct<file_path: string, operation: string, summary: string>>"
    ops = F.when(named == "apply_patch", tx.patch_operations(F.get_json_object(at("$.payload.arguments"), "$.patch"))).when(named.isin("shell", "shell_command") & shell.isNotNull(), F.array(shell)).otherwise(F.array().cast(operation))
    role = F.when(payload == "message", at("$.payload.role")).when(payload.isNotNull() & (kind == "response_item"), "tool").otherwise(kind)
    seen = good.select("path", "line", kind.alias("kind"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"), ops.alias("ops"), at("$.payload.cwd").alias("cwd"), at("$.payload.model").alias("model"),
                       times.or_line(at("$.timestamp").try_cast("timestamp"), F.col("line")).alias("ts"), F.when(kind == "session_meta", at("$.payload.id")).alias("meta_id"))
    file_session = F.lower(F.nullif(F.regexp_extract(tx.stem(F.col("path")), "([0-9a-fA-F-]{36})$", 1), F.lit("")))
    return seen.withColumn("session_id", F.coalesce("meta_id", file_session, F.lit("unknown"))).drop("meta_id")


def gemini_messages(rows: DataFrame) -> DataFrame:
    """Messages of session documents and log arrays; a document that is no JSON gives none."""
    document = F.try_parse_json("content")
    session = F.coalesce(F.get_json_object("content", "$.sessionId"), F.lit("unknown"))
    own = "array<struct<type: string, content: string, timestamp: string, model: string, sessionId: string, message: string>>"
    listed = F.when(F.schema_of_variant(document).startswith("ARRAY"), F.from_json("content", own)).otherwise(F.from_json(F.get_json_object("content", "$.messages"), own))
    rows = rows.select("path", session.alias("session_id"), F.posexplode(listed).alias("n", "m"))
    return rows.select("path", (F.col("n") + 1).cast("long").alias("line"), F.coalesce("m.sessionId", "session_id").alias("session_id"),
                       F.when(F.col("m.type") == "gemini", "assistant").otherwise(F.col("m.type")).alias("role"), F.coalesce("m.content", "m.message").alias("text"),
                       times.or_line(F.col("m.timestamp").try_cast("timestamp"), F.col("n").cast("long") + 1).alias("ts"), tx.component_after(F.col("path"), "tmp", F.lit("unknown")).alias("project_name"))


def event_text(tool_calls: Column) -> Column:
    """Sections of an event with columns source, type, status, content and thinking."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("unknown")))
    some = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}:\n"), c))
    return F.concat_ws("\n\n", part("Source", "source"), part("Type", "type"), part("Status", "status"), some("Content", F.col("content")), some("Thinking", F.col("thinking")), some("Tool calls", tool_calls))


def antigravity_events(rows: DataFrame) -> DataFrame:
    """One chunk text for each event of a transcript."""
    good = parsed(rows).where("reason IS NULL")
    at = lambda name: F.get_json_object("text", f"$.{name}").alias(name)
    events = good.select("path", "line", *[at(n) for n in ("source", "type", "status", "content", "thinking", "created_at", "step_index", "tool_calls")])
    session = tx.component_after(F.col("path"), "brain", tx.stem(F.col("path")))
    return events.select("path", "line", session.alias("session_id"), F.coalesce(F.col("step_index").cast("long"), "line").alias("step"), event_text(F.col("tool_calls")).alias("text"),
                         times.or_line(F.col("created_at").try_cast("timestamp"), F.col("line")).alias("ts"))


def printable(rows: DataFrame) -> DataFrame:
    """Printable text of binary conversations."""

    @F.pandas_udf(T.StringType())
    def decode(values):
        import re

        return values.map(lambda b: re.sub(r"\s+", " ", "".join(c if c.isprintable() or c in "\n\t\r" else " " for c in bytes(b).decode("utf-8", "ignore"))), na_action="ignore")

    return rows.select("path", decode("bytes").alias("text"))


def normal_role(role: Column) -> Column:
    low = F.lower(role)
    return F.when(low.isin("human", "user"), "user").when(low.isin("assistant", "claude"), "assistant").otherwise(F.coalesce(low, F.lit("unknown")))


def project_of_cwd(cwd: Column) -> Column:
    return F.coalesce(F.nullif(cwd, F.lit("")), F.lit("/unknown"))


_EXPORT_TEXT = ("text", "content", "message", "value")


def plain_text(value) -> str:
    """Text of a nested export value: strings joined by lines, maps by their first filled field."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "\n".join(t for t in map(plain_text, value) if t)
    if isinstance(value, dict):
        return next((t for t in (plain_text(value[k]) for k in ("parts", *_EXPORT_TEXT) if k in value) if t), "")
    return ""


@F.udf(T.StringType(), useArrow=True)
def nested_text(value: str) -> str:
    """The recursion over nested values has no built-in counterpart."""
    import json

    try:
        return plain_text(json.loads(value)) if value is not None else None
    except ValueError:
        return value


def export_messages(rows: DataFrame, source: str) -> DataFrame:
    """Messages of `conversations.json` exports (`chatgpt` or `claude_app`), in order, with their export line numbers."""
    document = F.col("content")
    top = F.when(F.trim(document).startswith("["), document).otherwise(F.get_json_object(document, "$.conversations"))
    talks = rows.select("path", F.posexplode(F.from_json(top, "array<string>")).alias("c", "talk"))
    at = lambda path, c="talk": F.get_json_object(c, path)
    name = F.coalesce(at("$.uuid"), at("$.id"), at("$.conversation_id"), F.lit("unknown"))
    if source == "chatgpt":
        mapped = F.transform(F.filter(F.map_values(F.from_json(at("$.mapping"), "map<string, string>")), lambda v: F.get_json_object(v, "$.message").isNotNull()), lambda v: F.get_json_object(v, "$.message"))
        when = lambda m: F.coalesce(F.get_json_object(m, "$.create_time"), F.get_json_object(m, "$.update_time"), F.lit("0")).try_cast("double")
        sort = F.transform(F.array_sort(F.transform(mapped, lambda m: F.struct(F.coalesce(when(m), F.lit(0.0)).alias("t"), m.alias("m")))), lambda x: x["m"])
        messages = F.coalesce(F.from_json(at("$.messages"), "array<string>"), sort)
    else:
        messages = F.coalesce(F.from_json(at("$.chat_messages"), "array<string>"), F.from_json(at("$.messages"), "array<string>"))
    each = talks.select("path", "c", name.alias("session_id"), F.coalesce(at("$.title"), at("$.name")).alias("title"), F.posexplode(messages).alias("n", "m"))
    m = lambda path: at(path, "m")
    role = F.coalesce(m("$.author.role"), m("$.role"), m("$.sender"), m("$.author"))
    text = F.coalesce(m("$.text"), m("$.content"), m("$.message"))
    line = F.col("c").cast("long") * 100_000 + F.col("n")
    return each.select("path", "session_id", "title", line.alias("line"), normal_role(role).alias("role"), F.trim(nested_text(text)).alias("text"),
                       times.from_export(F.coalesce(m("$.create_time"), m("$.created_at"), m("$.createdAt"), m("$.timestamp")), line).alias("ts"))


READERS = {"primary": primary_entries, "codex": codex_entries, "gemini": gemini_messages, "antigravity": antigravity_events, "antigravity_binary": printable, "chatgpt": export_messages, "claude_app": export_messages}
