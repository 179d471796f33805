"""Turns from conversation rows, their parts, ids and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..operators import chunking
from . import tables
from .registry import query

E = tables.ENTRIES_SQL
_TS = "strftime(ats, '%Y-%m-%d %H:%M:%S') || '+00:00'"
_PAIRS = f"""{E}, x AS (SELECT *, lag(role) OVER w AS prev, lag(text) OVER w AS utext, lag(line) OVER w AS uline, lag(ts) OVER w AS uts FROM entries WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY line)),
pairs AS (SELECT session_id, project_name, uline AS user_line, line AS assistant_line, trim(utext) AS user_text, trim(text) AS assistant_text, ts AS ats FROM x WHERE role = 'assistant' AND prev = 'user'),
turns AS (SELECT *, 'In project ' || project_name || CASE WHEN user_text <> '' AND assistant_text <> '' THEN ', user asked:' || chr(10) || user_text || chr(10) || chr(10) || 'Assistant responded:' || chr(10) || assistant_text
  WHEN user_text <> '' THEN ', user asked:' || chr(10) || user_text || chr(10) || chr(10) || '[No assistant response]' ELSE ', assistant response:' || chr(10) || assistant_text END AS content FROM pairs)"""


def _pairs(spark, sf_dir):
    return chunking.paired(tables.entries(spark, sf_dir))


@query("jon03_win02_turn_pairs", f"WITH {_PAIRS} SELECT session_id, user_line, assistant_line FROM pairs")
def jon03(spark, sf_dir):
    return _pairs(spark, sf_dir).select("session_id", "user_line", "assistant_line")


@query("jon03_unpaired_assistants", f"WITH {_PAIRS} SELECT session_id, line FROM x WHERE role = 'assistant' AND coalesce(prev, '') <> 'user'")
def jon03_unpaired(spark, sf_dir):
    return chunking.unpaired(tables.entries(spark, sf_dir)).select("session_id", "line")


@query("stm06_safe_interval", f"WITH {_PAIRS}, f AS (SELECT session_id, max(line) AS last FROM entries GROUP BY 1), m AS (SELECT session_id, last, last // 2 AS s FROM f), "
       "h AS (SELECT session_id, last(role ORDER BY line) AS role, max(line) AS line FROM entries WHERE role IN ('user', 'assistant') GROUP BY 1) "
       "SELECT m.session_id, least(m.s, coalesce(min(greatest(p.user_line - 1, 0)) FILTER (p.user_line <= m.s AND m.s < p.assistant_line), m.s)) AS safe_start, "
       "CASE WHEN any_value(h.role) = 'user' THEN any_value(h.line) - 1 ELSE m.last END AS safe_end FROM m LEFT JOIN pairs p USING (session_id) LEFT JOIN h USING (session_id) GROUP BY m.session_id, m.s, m.last")
def stm06(spark, sf_dir):
    e = tables.entries(spark, sf_dir)
    last = e.groupBy("session_id").agg(F.max("line").alias("end_inclusive"))
    return chunking.safe_interval(e, last.withColumn("start_exclusive", F.expr("end_inclusive div 2"))).select("session_id", "safe_start", "safe_end")


@query("jon04_agg20_win03_accumulated_turns", f"""WITH {E}, x AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS turn FROM entries WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
g AS (SELECT session_id, turn, min(line) AS line, any_value(text) FILTER (role = 'user') AS user_text, string_agg(text, chr(10) ORDER BY line) FILTER (role <> 'user') AS replies, count(*) FILTER (role <> 'user') AS n FROM x WHERE turn > 0 GROUP BY 1, 2)
SELECT session_id, CAST(turn AS BIGINT) AS turn, line, md5(user_text) AS user_md5, md5(coalesce(replies, '')) AS replies_md5, n FROM g""")
def jon04(spark, sf_dir):
    turns = chunking.accumulated(tables.entries(spark, sf_dir).where("role <> 'system'"))
    return turns.select("session_id", "turn", "line", F.md5("user_text").alias("user_md5"), F.md5("replies").alias("replies_md5"), F.col("n_replies").alias("n"))


@query("jon05_grouped_turn_text", f"""WITH {E}, x AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line) AS turn FROM entries WHERE role IN ('user', 'assistant') AND trim(text) <> ''),
g AS (SELECT session_id, turn, any_value(project_name) AS p, any_value(text) FILTER (role = 'user') AS u, string_agg(text, chr(10) ORDER BY line) FILTER (role <> 'user') AS a FROM x WHERE turn > 0 GROUP BY 1, 2)
SELECT session_id, CAST(turn AS BIGINT) AS turn, md5('In project ' || p || ', user asked:' || chr(10) || u || chr(10) || chr(10) || 'Assistant responded:' || chr(10) || coalesce(a, '')) AS content_md5 FROM g""")
def jon05(spark, sf_dir):
    turns = chunking.accumulated(tables.entries(spark, sf_dir).where("role <> 'system'"))
    return turns.select("session_id", "turn", F.md5(tx.grouped_turn(F.col("project_name"), F.col("user_text"), F.col("replies"))).alias("content_md5"))


@query("jon06_jon07_export_pairs", f"""WITH {E}, r AS (SELECT *, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS who FROM entries WHERE trim(text) <> ''), x AS (SELECT *, lag(who) OVER (PARTITION BY session_id ORDER BY line) AS prev, lag(line) OVER (PARTITION BY session_id ORDER BY line) AS uline FROM r)
SELECT session_id, uline AS user_line, line AS assistant_line FROM x WHERE who = 'assistant' AND prev = 'user'""")
def jon06(spark, sf_dir):
    return chunking.paired_exports(tables.entries(spark, sf_dir)).select("session_id", "user_line", "assistant_line")


@query("win04_carried_forward", f"WITH {E} SELECT session_id, line, last_value(CASE WHEN line % 3 = 1 THEN text END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS seen FROM entries")
def win04(spark, sf_dir):
    e = tables.entries(spark, sf_dir).withColumn("cwd", F.when(F.col("line") % 3 == 1, F.col("text")))
    return chunking.carried(e, "cwd").select("session_id", "line", F.col("cwd").alias("seen"))


def _break(s: str) -> str:
    """SQL for where the part that begins at ``s`` ends."""
    low = f"greatest({s}, {s} + 7000)"
    region = f"substr(text, {low} + 1, 1000)"
    rfind = lambda m, n: f"(CASE WHEN strpos(reverse({region}), reverse({m})) = 0 THEN -1 ELSE 1000 - strpos(reverse({region}), reverse({m})) - {n - 1} END)"
    para = rfind("chr(10) || chr(10)", 2)
    best = f"greatest({rfind(chr(39) + '. ' + chr(39), 2)}, {rfind(chr(39) + '! ' + chr(39), 2)}, {rfind(chr(39) + '? ' + chr(39), 2)}, {rfind('chr(10)', 1)})"
    return f"CASE WHEN {s} + 8000 >= length(text) THEN length(text) WHEN {para} > 0 THEN {low} + {para} + 2 WHEN {best} > 0 THEN {low} + {best} + 1 ELSE {s} + 8000 END"


def _split_sql(rows: str, keys: str) -> str:
    """Relation p of all parts (i from 1, text from s to e) of all texts of the relation ``rows`` (keys, text)."""
    return f"""p AS (
 SELECT {keys}, text, 1 AS i, 0 AS s, brk AS e FROM (SELECT *, {_break("0")} AS brk FROM {rows})
 UNION ALL SELECT {keys}, text, i + 1, ns, {_break("ns")} FROM (SELECT {keys}, text, i, greatest(s + 1, e - 1500) AS ns FROM p WHERE e < length(text)))"""


def _ids_sql(keys: str, session: str, time: str) -> str:
    """Relations q and c: parts with their number, content, id and parent."""
    base = f"substr(sha256(text || {session} || {time}), 1, 16)"
    return f"""q AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n, substr(text, s + 1, e - s) AS t FROM p),
c AS (SELECT *, CASE WHEN n = 1 THEN t ELSE '[Part ' || i || '/' || n || '] ' || t END AS content, {base} AS base, {session} || {time} AS salt FROM q),
parts AS (SELECT *, CASE WHEN n = 1 THEN base ELSE substr(sha256(content || salt || '_part' || i), 1, 16) END AS id, CASE WHEN i > 1 THEN base END AS parent_chunk_id FROM c)"""


@query("str01_split_content", f"WITH RECURSIVE {_split_sql('documents', 'doc_id')} SELECT doc_id, i AS part, md5(substr(text, s + 1, e - s)) AS part_md5 FROM p")
def str01(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    short = d.where(F.length("text") <= fixed.SPLIT_MAX).select("doc_id", F.lit(0).alias("i"), F.col("text").alias("part_text"))
    long = d.where(F.length("text") > fixed.SPLIT_MAX).select("doc_id", F.posexplode(tx.split_parts("text")).alias("i", "part_text"))  # only these reach Python
    return short.unionByName(long).select("doc_id", (F.col("i") + 1).alias("part"), F.md5("part_text").alias("part_md5"))


_DOC_PARTS = f"WITH RECURSIVE {_split_sql('documents', 'doc_id')}, {_ids_sql('doc_id', chr(39) + 's' + chr(39) + ' || doc_id', chr(39) + '2026-01-01 00:00:00+00:00' + chr(39))}"


@query("prj22_str03_win05_parts", f"{_DOC_PARTS} SELECT doc_id, i AS part, n AS parts, id, parent_chunk_id FROM parts")
def prj22(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"), F.lit("2026-01-01 00:00:00+00:00").alias("time"))
    return chunking.with_parts(rows).select("doc_id", "part", F.col("parts").cast("long").alias("parts"), "id", "parent_chunk_id")


_TURN_PARTS = _PAIRS + ", " + _split_sql(f"(SELECT session_id, user_line, {_TS} AS time, content AS text FROM turns WHERE user_text <> '' OR assistant_text <> '')", "session_id, user_line, time") + ", " + _ids_sql("session_id, user_line", "session_id", "time")


@query("str04_turn_chunks", f"WITH RECURSIVE {_TURN_PARTS} SELECT session_id, user_line, sha256(content) AS content_sha, id FROM parts")
def str04(spark, sf_dir):
    turns = chunking.turn_chunks(_pairs(spark, sf_dir))
    return turns.select("session_id", "user_line", F.sha2("content", 256).alias("content_sha"), "id")


@query("jon08_parent_and_children", f"""WITH {_PAIRS}, t AS (SELECT session_id, user_line, substr(sha256(content || session_id || {_TS}), 1, 16) AS id FROM turns),
f AS (SELECT session_id, user_line, unnest(range(0, user_line % 3)) AS k FROM turns) SELECT t.session_id, t.user_line, t.id, count(f.k) AS children FROM t LEFT JOIN f USING (session_id, user_line) GROUP BY ALL""")
def jon08(spark, sf_dir):
    turns = chunking.turn_chunks(_pairs(spark, sf_dir)).where("part = 1").select("session_id", "user_line", F.col("base_id").alias("id"))
    changes = turns.select("session_id", "user_line", F.explode(F.sequence(F.lit(1), F.col("user_line") % 3)).alias("k")).where("user_line % 3 >= k AND k > 0")
    changes = changes.select("session_id", "user_line", F.concat_ws("-", "session_id", "user_line", "k").alias("change_id"))
    return chunking.linked(turns, changes).select("session_id", "user_line", "id", F.size("child_chunk_ids").cast("long").alias("children"))


@query("agg04_chunk_counts", f"WITH {tables.CHUNKS_SQL} SELECT source_file, chunk_type, count(*) AS n FROM chunks GROUP BY ALL")
def agg04(spark, sf_dir):
    return tables.chunks(spark, sf_dir).groupBy("source_file", "chunk_type").agg(F.count(F.lit(1)).alias("n"))


@query("flt17_skipped_entries", f"WITH {E} SELECT session_id, count(*) FILTER (role IN ('user', 'assistant')) AS kept, count(*) FILTER (role NOT IN ('user', 'assistant')) AS skipped FROM entries GROUP BY 1")
def flt17(spark, sf_dir):
    known = F.col("role").isin("user", "assistant")
    return tables.entries(spark, sf_dir).groupBy("session_id").agg(F.count_if(known).alias("kept"), F.count_if(~known).alias("skipped"))
