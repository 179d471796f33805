"""Readers run over file texts that are made of the given conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import chunking
from ..sources import readers
from . import tables
from .registry import query

T = tables


def _json_line():
    message = F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))
    return F.to_json(F.struct(F.col("role").alias("type"), F.col("session_id").alias("sessionId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), message.alias("message")))


def log_files(spark, sf_dir):
    """One primary log for each conversation, as (path, content)."""
    e = T.entries(spark, sf_dir).withColumn("j", _json_line())
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "j"))), lambda x: x["j"])
    return e.groupBy("session_id", "project_name").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("content")).select(
        F.concat(F.lit("/home/-"), "project_name", F.lit("/"), "session_id", F.lit(".jsonl")).alias("path"), "content")


@query("src01_log_lines", "SELECT '/home/-p' || (conv_id % 5) || '/c' || conv_id || '.jsonl' AS path, count(*) AS lines FROM conversations WHERE turn >= 1 GROUP BY 1")
def src01(spark, sf_dir):
    return readers.lines(log_files(spark, sf_dir), start=1).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@query("src02_src03_prj03_entries", "SELECT 'c' || conv_id AS session_id, CAST(turn + 1 AS BIGINT) AS line, role, md5(text) AS text_md5, '/p' || (conv_id % 5) AS project_path FROM conversations")
def src02(spark, sf_dir):
    e = readers.primary_entries(readers.lines(log_files(spark, sf_dir)))
    return e.select("session_id", "line", "role", F.md5("text").alias("text_md5"), "project_path")


@query("src01_jon03_turns_from_files", f"WITH {T.ENTRIES_SQL}, x AS (SELECT *, lag(role) OVER w AS prev, lag(line) OVER w AS uline FROM entries WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY line)) SELECT session_id, uline AS user_line, line AS assistant_line FROM x WHERE role = 'assistant' AND prev = 'user'")
def src01_turns(spark, sf_dir):
    e = readers.primary_entries(readers.lines(log_files(spark, sf_dir)))
    return chunking.paired(e).select("session_id", "user_line", "assistant_line")


@query("src15_src16_line_counts", "SELECT 'c' || conv_id AS session_id, count(*) AS n FROM conversations GROUP BY 1")
def src16(spark, sf_dir):
    f = log_files(spark, sf_dir)
    return f.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"), readers.line_count(F.col("content")).alias("n"))


@query("src17_prefix_digests", "SELECT doc_id, sha256(array_to_string(list_slice(l, 1, 3), chr(10)) || CASE WHEN len(l) > 3 THEN chr(10) ELSE '' END) AS digest FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def src17(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", readers.prefix_digest(F.col("text"), F.lit(3)).alias("digest"))


_LOG = [
    (1, '{"type":"assistant","sessionId":"s","message":{"model":"m1","content":[{"type":"text","text":"Hi §"},{"type":"tool_use","id":"t1","name":"Edit","input":{"file_path":"a§.py","old_string":"x","new_string":"y"}},{"type":"tool_use","id":"t2","name":"Bash","input":{"command":"ls -l"}},{"type":"tool_result","content":"ok"}]}}'),
    (2, '{"type":"user","sessionId":"s","message":{"content":"plain §"}}'), (3, "[1, 2]"), (4, "not json §"), (5, '{"type":""}'), (6, '{"type":"assistant","message":{"content":[{"type":"tool_use","id":"t3","name":"Write","input":{"file_path":"b§.py"}},{"type":"tool_use","name":"Grep","input":{}}]}}'),
]


def _lines(spark, sf_dir, folder, rows):
    """A file of one line for every document, numbered as the document is."""
    made = T.varied(spark, sf_dir, "line, text", rows)
    return made.select(F.concat(F.lit(folder), F.col("line").cast("string"), F.lit(".jsonl")).alias("path"), F.col("line").cast("long").alias("line"), "text")


def _log(spark, sf_dir):
    return _lines(spark, sf_dir, "/home/-proj/s", _LOG)


@query("prj03_flattened_blocks", T.expected_sql("text", [(0, "Hi §\n[Used Edit on a§.py]\n[Ran command: ls -l]\n[Result: ok]"), (1, "plain §"), (5, "[Used Write on b§.py]\n[Used Grep]")], 6, "line"))
def prj03(spark, sf_dir):
    return readers.primary_entries(_log(spark, sf_dir)).select("line", "text")


@query("prj04_file_operations", T.expected_sql("file_path, operation, summary, tool_id", [(0, "a§.py", "edit", "Replaced 'x' with 'y'", "t1"), (5, "b§.py", "write", "Created/overwrote file", "t3")], 6, "line"))
def prj04(spark, sf_dir):
    return readers.primary_entries(_log(spark, sf_dir)).select("line", F.inline("ops")).select("line", "file_path", "operation", "summary", "tool_id")


@query("src02_flt14_rejected_lines", T.expected_sql("reason", [(2, "not_an_object"), (3, "invalid_json"), (4, "no_type")], 6, "line"))
def src02_rejects(spark, sf_dir):
    return readers.parsed(_log(spark, sf_dir)).where("reason IS NOT NULL").select("line", "reason")


_CODEX = [
    (1, '{"type":"session_meta","payload":{"id":"abc","cwd":"/w/app"}}'), (2, '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"fix it §"}]}}'),
    (3, '{"type":"response_item","payload":{"type":"function_call","name":"shell","arguments":"{\\"command\\":\\"rm old§.txt\\"}"}}'), (4, '{"type":"response_item","payload":{"type":"function_call_output","output":"done §"}}'),
    (5, '{"type":"response_item","payload":{"type":"reasoning","summary":["a§","b"]}}'), (6, '{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"fixed §"}]}}'),
    (7, '{"type":"event_msg","payload":{"type":"user_message","message":"more §"}}'), (8, '{"type":"response_item","payload":{"type":"web_search_call","action":{"query":"spark §"}}}'),
]
_CODEX_ROWS = [(0, "session_meta", "", 0), (1, "user", "fix it §", 0), (2, "tool", '[Tool call] shell {"command":"rm old§.txt"}', 1), (3, "tool", "[Tool output] done §", 0), (4, "tool", "[Reasoning summary] a§ b", 0), (5, "assistant", "fixed §", 0), (6, "event_msg", "more §", 0), (7, "tool", "[Web search] spark §", 0)]


@query("src04_prj05_prj06_codex_events", T.expected_sql("role, text, n_ops", _CODEX_ROWS, 8, "line"))
def src04(spark, sf_dir):
    return readers.codex_entries(_lines(spark, sf_dir, "/x/rollout", _CODEX)).select("line", "role", "text", F.size("ops").cast("long").alias("n_ops"))


_DOCS = [(0, '{"sessionId":"g§","messages":[{"type":"user","content":"q §"},{"type":"gemini","content":"a","timestamp":"2026-01-01T00:00:00Z"}]}'), (1, '[{"sessionId":"l§","type":"user","message":"m"}]'), (2, "broken §")]


@query("src05_gemini_messages", T.expected_sql("session_id, line, role, text", [(0, "g§", 1, "user", "q §"), (0, "g§", 2, "assistant", "a"), (1, "l§", 1, "user", "m")], 3))
def src05(spark, sf_dir):
    rows = T.varied(spark, sf_dir, "i, content", _DOCS).select(F.concat(F.lit("/u/tmp/h"), F.col("i").cast("string"), F.lit("/logs.json")).alias("path"), "content")
    return readers.gemini_messages(rows).select("session_id", "line", "role", "text")


_TRANSCRIPT = "/h/brain/b§/logs/transcript_full.jsonl"
_STEPS = [(1, _TRANSCRIPT, '{"step_index":0,"source":"USER","type":"INPUT","status":"DONE","content":"hello §"}'), (2, _TRANSCRIPT, '{"type":"PLAN","thinking":"hm §"}')]


@query("src06_prj12_antigravity_events", T.expected_sql("session_id, text", [(0, "b§", "Source: USER\n\nType: INPUT\n\nStatus: DONE\n\nContent:\nhello §"), (1, "b§", "Source: unknown\n\nType: PLAN\n\nStatus: unknown\n\nThinking:\nhm §")], 2, "line"))
def src06(spark, sf_dir):
    rows = T.varied(spark, sf_dir, "line, path, text", _STEPS).select("path", F.col("line").cast("long").alias("line"), "text")
    return readers.antigravity_events(rows).select("session_id", "line", "text")


@query("src07_printable_text")
def src07(spark, sf_dir):
    rows = T.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.encode("html", "utf-8").alias("bytes"))
    return readers.printable(rows)


_CHATGPT = [(0, '[{"id":"k§","title":"t","mapping":{"b":{"message":{"author":{"role":"assistant"},"create_time":2,"content":{"parts":["yes §"]}}},"a":{"message":{"author":{"role":"user"},"create_time":1,"content":{"parts":["ask","me"]}}},"r":{}}},{"id":"l§","messages":[{"role":"user","content":"x","create_time":5}]}]')]


def _exported(spark, sf_dir, rows):
    return T.varied(spark, sf_dir, "i, content", rows).select(F.concat(F.lit("/e"), F.col("i").cast("string"), F.lit("/conversations.json")).alias("path"), "content")


@query("src08_prj13_top09_chatgpt", T.expected_sql("session_id, line, role, text", [(0, "k§", 0, "user", "ask\nme"), (0, "k§", 1, "assistant", "yes §"), (0, "l§", 100_000, "user", "x")], 1))
def src08(spark, sf_dir):
    return readers.export_messages(_exported(spark, sf_dir, _CHATGPT), "chatgpt").select("session_id", "line", "role", "text")


_CLAUDE = [(0, '{"conversations":[{"uuid":"u§","name":"n","chat_messages":[{"sender":"human","text":"hi §"},{"sender":"claude","content":[{"text":"yo"}]}]}]}')]


@query("src09_prj14_claude_app", T.expected_sql("session_id, line, role, text", [(0, "u§", 0, "user", "hi §"), (0, "u§", 1, "assistant", "yo")], 1))
def src09(spark, sf_dir):
    return readers.export_messages(_exported(spark, sf_dir, _CLAUDE), "claude_app").select("session_id", "line", "role", "text")


@query("str01_split_limits", "SELECT doc_id, length(text) > 8000 AS split FROM documents")
def split_limits(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > fixed.SPLIT_MAX).alias("split"))
