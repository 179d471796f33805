"""Scalar functions over documents, pages and events, and over rows that documents make of templates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import fixed, times
from ..functions import text as tx
from ..operators import evaluate
from . import tables
from .registry import query

T = tables


def _docs(spark, sf_dir):
    return T.table(spark, sf_dir, "documents")


_PATHS = [(0, "-Users-ann-projects-§"), (1, "§"), (2, "-a-..-§"), (3, "--double§"), (4, ""), (5, "-home-§-y_z")]


@query("prj01_prj02_project_path", f"WITH {T.varied_sql('p', 'i, d', _PATHS)}, r AS (SELECT i, CASE WHEN contains(d, '..') THEN '/invalid/path' ELSE '/' || replace(regexp_replace(d, '^-', ''), '-', '/') END AS path FROM p) SELECT i, path, list_extract(string_split(regexp_replace(path, '/+$', ''), '/'), -1) AS name FROM r")
def prj01(spark, sf_dir):
    p = T.varied(spark, sf_dir, "i, d", _PATHS).select("i", tx.project_path(F.col("d")).alias("path"))
    return p.select("i", "path", tx.last_component(F.col("path")).alias("name"))


@query("prj02_source_names", "SELECT doc_id, list_extract(string_split('/work/' || source || '/', '/'), -2) AS name FROM documents")
def prj02(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.last_component(F.concat(F.lit("/work/"), "source", F.lit("/"))).alias("name"))


_FILES = [
    (0, "/logs/rollout-2026-01-01T00-00-00-0F8FAD5B-D9CB-469F-A165-70867728950E.jsonl"), (1, "/logs/short§.jsonl"), (2, "/x/tmp/abc§/chats/s.json"), (3, "/y/brain/§/logs/t.jsonl"),
    (4, "/y/brain"), (5, "/tmp/§/logs.json"), (6, "/q/r.name.§.dots.jsonl"),
]
_STEM = "regexp_replace(list_extract(string_split(f, '/'), -1), '(.)\\.[^.]*$', '\\1')"


@query("prj07_prj09_prj11_names_from_paths", f"WITH {T.varied_sql('p', 'i, f', _FILES)}, s AS (SELECT i, f, {_STEM} AS stem, string_split(f, '/') AS parts FROM p) SELECT i, CASE WHEN regexp_full_match(right(stem, 36), '[0-9a-fA-F-]{{36}}') THEN lower(right(stem, 36)) END AS codex, coalesce(parts[list_position(parts, 'tmp') + 1], 'unknown') AS gemini, coalesce(CASE WHEN list_position(parts, 'brain') > 0 THEN parts[list_position(parts, 'brain') + 1] END, stem) AS antigravity FROM s")
def prj07(spark, sf_dir):
    f = F.col("f")
    stem = tx.stem(f)
    p = T.varied(spark, sf_dir, "i, f", _FILES)
    return p.select(
        "i", F.lower(F.nullif(F.regexp_extract(stem, "([0-9a-fA-F-]{36})$", 1), F.lit(""))).alias("codex"),
        tx.component_after(f, "tmp", F.lit("unknown")).alias("gemini"), tx.component_after(f, "brain", stem).alias("antigravity"),
    )


_EVENTS = [(0, "user", "MSG", "done", "hello §", None), (1, None, "TOOL §", None, None, "hm"), (2, "model", None, "ok", "", "§")]


@query("prj12_event_text", f"""WITH {T.varied_sql('e', 'i, author, kind, status, content, thinking', _EVENTS)} SELECT i, concat_ws(chr(10) || chr(10), 'Source: ' || coalesce(author, 'unknown'), 'Type: ' || coalesce(kind, 'unknown'), 'Status: ' || coalesce(status, 'unknown'),
CASE WHEN content <> '' THEN 'Content:' || chr(10) || content END, CASE WHEN thinking <> '' THEN 'Thinking:' || chr(10) || thinking END) AS text FROM e""")
def prj12(spark, sf_dir):
    from ..sources import readers

    return T.varied(spark, sf_dir, "i, source, type, status, content, thinking", _EVENTS).select("i", readers.event_text(F.lit(None).cast("string")).alias("text"))


_ROLES = [(0, "Human"), (1, "user"), (2, "ASSISTANT"), (3, "claude"), (4, "System§"), (5, None)]


@query("prj08_prj15_prj16_roles", f"WITH {T.varied_sql('r', 'i, role', _ROLES)} SELECT i, lower(coalesce(role, '')) AS plain, CASE WHEN lower(role) IN ('human', 'user') THEN 'user' WHEN lower(role) IN ('assistant', 'claude') THEN 'assistant' ELSE lower(coalesce(role, 'unknown')) END AS role, coalesce(nullif(role, ''), '/unknown') AS project FROM r")
def prj15(spark, sf_dir):
    from ..sources import readers

    r = F.col("role")
    return T.varied(spark, sf_dir, "i, role", _ROLES).select("i", F.lower(F.coalesce(r, F.lit(""))).alias("plain"), readers.normal_role(r).alias("role"), readers.project_of_cwd(r).alias("project"))


@query("str02_chunk_ids", "SELECT doc_id, substr(sha256(text || 's' || doc_id || '2026-01-01 00:00:' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || CASE WHEN doc_id % 3 > 0 THEN '.' || lpad(CAST(doc_id % 3 AS VARCHAR), 6, '0') ELSE '' END || '+00:00'), 1, 16) AS id FROM documents")
def str02(spark, sf_dir):
    n = F.col("doc_id")
    ts = F.timestamp_micros((F.lit(1767225600) + n % 60) * 1_000_000 + n % 3)
    return _docs(spark, sf_dir).select("doc_id", tx.chunk_id(F.col("text"), F.concat(F.lit("s"), n.cast("string")), tx.time_text(ts)).alias("id"))


@query("str05_grouped_templates", "SELECT doc_id, md5('In project ' || source || ', assistant responded:' || chr(10) || text) AS reply, md5('In project ' || source || ', user said:' || chr(10) || text) AS said FROM documents")
def str05(spark, sf_dir):
    p, t = F.col("source"), F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.grouped_turn(p, None, t)).alias("reply"), F.md5(tx.grouped_turn(p, t, None)).alias("said"))


@query("str06_summaries", "SELECT doc_id, md5('Session summary for ' || source || ':' || chr(10) || trim(coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN lang END), ''), text))) AS summary FROM documents")
def str06(spark, sf_dir):
    legacy = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.session_summary(F.col("source"), legacy, F.col("text"))).alias("summary"))


_CUT200 = "CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END"


@query("str07_file_change_text", f"SELECT doc_id, 'In project ' || source || ', file /f was edit. sum. This was in response to: ' || {_CUT200} AS content, substr(sha256('In project ' || source || ', file /f was edit. sum. This was in response to: ' || {_CUT200} || 's1' || 't/fidx0'), 1, 16) AS id FROM documents")
def str07(spark, sf_dir):
    content = tx.file_change(F.col("source"), F.lit("/f"), F.lit("edit"), F.lit("sum"), F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", content.alias("content"), tx.chunk_id(content, F.lit("s1"), F.lit("t/fidx0")).alias("id"))


@query("str08_other_file_change_text", "SELECT doc_id, 'In project ' || source || ', file /f was write.' || chr(10) || 'Summary: ' || lang AS content FROM documents")
def str08(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.file_change(F.col("source"), F.lit("/f"), F.lit("write"), F.col("lang")).alias("content"))


_COMMANDS = [
    (0, "rm -rf build/§"), (1, "mv a.txt §.txt"), (2, "cp x §"), (3, "touch §.py"), (4, "mkdir -p a/§"), (5, "echo hi > §.log"), (6, "cat a | tee -a §.txt"),
    (7, "sed -i s/a/b/ §.c"), (8, "ls -la §"), (9, "git rm §.py && touch x"), (10, ""), (11, "echo a >§"),
]


def _shell_sql() -> tuple[str, str]:
    paths, operations = [], []
    for pattern, operation, _ in fixed.SHELL_OPERATIONS:
        group = re.compile(pattern.replace("?<", "?P<")).groupindex["path"]
        plain = pattern.replace("?<path>", "").replace("'", "''")
        paths.append(f"nullif(regexp_extract(c, '{plain}', {group}), '')")
        operations.append(f"WHEN regexp_extract(c, '{plain}', {group}) <> '' THEN '{operation}'")
    return "coalesce(" + ", ".join(paths) + ")", "CASE " + " ".join(operations) + " END"


@query("str09_str10_str11_shell_operations", f"WITH {T.varied_sql('s', 'i, c', _COMMANDS)} SELECT i, {_shell_sql()[0]} AS file_path, {_shell_sql()[1]} AS operation FROM s")
def str09(spark, sf_dir):
    op = tx.shell_operation(F.col("c"))
    return T.varied(spark, sf_dir, "i, c", _COMMANDS).select("i", op["file_path"].alias("file_path"), op["operation"].alias("operation"))


_PATCHES = [(0, "*** Begin Patch\n*** Add File: a/§.py\n+x\n*** Update File: c.py \n*** Move to: d.py\n-y"), (1, "*** Delete File: §.txt"), (2, "nothing here §")]


@query("str12_str13_str14_patches", f"""WITH {T.varied_sql('p', 'i, patch', _PATCHES)}, l AS (SELECT i, unnest(string_split(patch, chr(10))) AS line FROM p)
SELECT i, trim(substr(line, length(h) + 1)) AS file_path, op AS operation FROM l, (VALUES {", ".join(f"('{h}', '{o}')" for h, o, _ in fixed.PATCH_HEADERS)}) t(h, op) WHERE starts_with(line, h)""")
def str12(spark, sf_dir):
    ops = T.varied(spark, sf_dir, "i, patch", _PATCHES).select("i", F.inline(tx.patch_operations(F.col("patch"))))
    return ops.select("i", "file_path", "operation")


_COMPARABLE = "regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^\\pL\\pN\\pM_\\s]', '', 'g')"


@query("str18_comparable_text", f"SELECT doc_id, md5({_COMPARABLE}) AS form FROM documents")
def str18(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tx.comparable(F.col("text"))).alias("form"))


@query("str20_sentences", "SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS all_md5 FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS s FROM documents)")
def str20(spark, sf_dir):
    s = tx.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("all_md5"))


@query("str21_cut_at_word", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE CASE WHEN sp >= 350 THEN substr(h, 1, sp) ELSE h END || '...' END AS cut FROM (SELECT doc_id, text, substr(text, 1, 500) AS h, CASE WHEN strpos(reverse(substr(text, 1, 500)), ' ') = 0 THEN -1 ELSE 500 - strpos(reverse(substr(text, 1, 500)), ' ') END AS sp FROM documents)")
def str21(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.cut_at_word(F.col("text"), 500).alias("cut"))


_CODE = [(0, "see ```python\nprint(§)\n``` and ```\nls -l\n```"), (1, "no code"), (2, "```js\n\n``` empty"), (3, "a ```c\nint x;\n``` b ```c\nint x;\n```")]


@query("str22_code_blocks", f"""WITH {T.varied_sql('c', 'i, t', _CODE)}, m AS (SELECT i, unnest(regexp_extract_all(t, '(?s)```(\\w*)\\n(.*?)```', 1)) AS l, unnest(regexp_extract_all(t, '(?s)```(\\w*)\\n(.*?)```', 2)) AS c FROM c)
SELECT DISTINCT i, CASE WHEN l = '' THEN 'text' ELSE l END AS language, md5(trim(c, chr(10) || ' ')) AS code_md5 FROM m WHERE trim(c, chr(10) || ' ') <> ''""")
def str22(spark, sf_dir):
    blocks = T.varied(spark, sf_dir, "i, t", _CODE).select("i", F.inline(tx.code_blocks(F.col("t"))))
    return blocks.select("i", "language", F.md5("code").alias("code_md5")).distinct()


@query("str17_cleaned_text")
def str17(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("clean"))


@query("str19_similarity")
def str19(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("t"))
    following = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return d.join(following, "doc_id").select("doc_id", F.round(tx.similarity_ratio(tx.comparable(F.col("t")), tx.comparable(F.col("u"))), 9).alias("ratio"))


_TERMS = [(0, "src/§/main.py"), (1, "§.py"), (2, "/§"), (3, "../§"), (4, "a/§/"), (5, ".env"), (6, " ")]


@query("str30_flt19_file_terms", f"""WITH {T.varied_sql('p', 'i, f', _TERMS)}, b AS (SELECT i, f, regexp_extract(f, '[^/]*$') AS base, regexp_replace(regexp_replace(f, '[^/]*$', ''), '(.)/$', '\\1') AS dir FROM p),
l AS (SELECT i, f, list_filter([f, nullif(base, ''), CASE WHEN dir <> '' AND dir <> '/' THEN dir END, CASE WHEN regexp_replace(base, '([^.])\\.[^.]*$', '\\1') NOT IN ('', base) THEN regexp_replace(base, '([^.])\\.[^.]*$', '\\1') END], lambda x: x IS NOT NULL) AS t FROM b)
SELECT i, CASE WHEN trim(f) = '' OR contains(f, '..') THEN '' ELSE array_to_string(list_filter(t, lambda x, k: list_position(t, x) = k), '|') END AS terms FROM l""")
def str30(spark, sf_dir):
    return T.varied(spark, sf_dir, "i, f", _TERMS).select("i", F.array_join(tx.file_terms(F.col("f")), "|").alias("terms"))


@query("set02_distinct_terms", "WITH q AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS l FROM documents), w AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS i FROM q), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY 1, 2) SELECT doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms FROM q LEFT JOIN f USING (doc_id) GROUP BY 1")
def set02(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_distinct(tx.tokens(F.col("text"))), " ").alias("terms"))


@query("str31_cache_keys", "SELECT doc_id, substr(sha256(concat_ws('|', trim(lower(text)), source, 'hybrid', '5', lang)), 1, 32) AS key FROM documents")
def str31(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.cache_key(F.col("text"), F.col("source"), F.lit("hybrid"), F.lit(5), F.col("lang")).alias("key"))


@query("str32_short_digests", "SELECT page_id, substr(sha256(url), 1, 12) AS digest FROM pages")
def str32(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 12).alias("digest"))


_URLS = [(0, "https://user:§@Example.com:8080/p?q=1#f"), (1, "http://host/§"), (2, "redis://:§@cache:6379/0"), (3, "not a url §"), (4, "https://§@api.example.org")]


@query("str33_redacted_urls", f"WITH {T.varied_sql('u', 'i, u', _URLS)} SELECT i, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') THEN lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(u, '@([^/?#:]*)', 1)) || regexp_extract(u, '@[^/?#:]*(.*)$', 1) ELSE u END AS url FROM u")
def str33(spark, sf_dir):
    return T.varied(spark, sf_dir, "i, u", _URLS).select("i", tx.redact_url(F.col("u")).alias("url"))


@query("str34_reason_texts", "SELECT doc_id, substr(coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9_.:-]+', '_', 'g'), '_'), ''), 'unknown'), 1, 120) AS reason, substr(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f]+', ' ', 'g')), 1, 256) AS name FROM documents")
def str34(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.reason_text(F.col("text")).alias("reason"), tx.client_name(F.col("text")).alias("name"))


@query("str35_prefixes", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'search_document: ' || lang ELSE lang END AS document, CASE WHEN doc_id % 2 = 0 THEN 'search_query: ' || lang ELSE lang END AS question FROM documents")
def str35(spark, sf_dir):
    model = F.when(F.col("doc_id") % 2 == 0, "nomic-embed-text").otherwise("bge-m3")
    with_prefix = lambda p: F.when(model.contains("nomic"), F.concat(F.lit(p), "lang")).otherwise(F.col("lang"))
    return _docs(spark, sf_dir).select("doc_id", with_prefix("search_document: ").alias("document"), with_prefix("search_query: ").alias("question"))


_BOUNDS_SQL = """x AS (SELECT event_id AS i, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
WHEN 3 THEN '  ' WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.5' END AS b FROM events)"""
_MIDDLE = "2026-01-15 12:00:00"


def _bounds(spark, sf_dir):
    """The times of the events as users give them: days, moments with and without zone, blank and absent."""
    shown = lambda f: F.date_format(F.col("ts").cast("timestamp"), f)
    k = F.col("event_id") % 6
    b = F.when(k == 0, shown("yyyy-MM-dd")).when(k == 1, shown("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, shown("yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(k == 3, "  ").when(k == 5, shown("yyyy-MM-dd HH:mm:ss'.5'"))
    return T.table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), b.alias("b"))


_LOW = "CASE WHEN trim(b) = '' OR b IS NULL THEN NULL WHEN length(trim(b)) = 10 THEN CAST(trim(b) || ' 00:00:00+00' AS TIMESTAMPTZ) WHEN regexp_matches(b, '(Z|[+-]\\d\\d:\\d\\d)$') THEN CAST(b AS TIMESTAMPTZ) ELSE CAST(b || '+00' AS TIMESTAMPTZ) END"


@query("dat01_dat03_time_bounds", f"WITH {_BOUNDS_SQL} SELECT i, epoch_us({_LOW}) AS low, epoch_us({_LOW}) + CASE WHEN length(trim(b)) = 10 THEN 86399999999 ELSE 0 END AS high FROM x")
def dat01(spark, sf_dir):
    b = F.col("b")
    return _bounds(spark, sf_dir).select("i", F.unix_micros(times.bound(b)).alias("low"), F.unix_micros(times.bound(b, end_of_day=True)).alias("high"))


@query("dat02_range_check", f"WITH {_BOUNDS_SQL} SELECT i, coalesce({_LOW} <= TIMESTAMPTZ '{_MIDDLE}+00', true) AS valid FROM x")
def dat02(spark, sf_dir):
    return _bounds(spark, sf_dir).select("i", times.ordered(times.bound(F.col("b")), F.lit(_MIDDLE).cast("timestamp")).alias("valid"))


@query("dat03_formatted_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z' AS shown FROM events")
def dat03(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", times.shown(F.col("ts").cast("timestamp")).alias("shown"))


@query("dat04_dat05_missing_times", "SELECT event_id, epoch_us(CASE WHEN event_id % 4 = 0 THEN make_timestamp(event_id) ELSE ts END) AS micros FROM events")
def dat05(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", F.unix_micros(times.or_line(F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp")), F.col("event_id"))).alias("micros"))


@query("dat06_export_times", "SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS micros FROM events")
def dat06(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    given = F.when(F.col("event_id") % 2 == 0, seconds.cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return T.table(spark, sf_dir, "events").select("event_id", F.unix_micros(times.from_export(given, F.col("event_id"))).alias("micros"))


@query("mth02_relevance_to_distance", "SELECT event_id, 1 - least(1.0, greatest(0.0, value / 100)) AS distance FROM events")
def mth02(spark, sf_dir):
    r = F.col("value") / 100
    bad = r.isNull() | F.isnan(r) | (F.abs(r) == float("inf"))
    return T.table(spark, sf_dir, "events").select("event_id", F.when(bad, 1.0).otherwise(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), r))).alias("distance"))


@query("mth04_synthesis_confidence", "SELECT conv_id, round(least(1.0, count(*) / 5.0) * 0.4 + least(1.0, max(turn) / 3.0) * 0.4 + CASE WHEN min(turn) = 0 AND max(turn) = 0 THEN 0.5 WHEN max(turn) <= count(*) THEN 0.8 ELSE 0.6 END * 0.2, 9) AS confidence FROM conversations GROUP BY conv_id")
def mth04(spark, sf_dir):
    n, points = F.count(F.lit(1)), F.max("turn")
    variety = F.when((F.min("turn") == 0) & (points == 0), 0.5).when(points <= n, 0.8).otherwise(0.6)
    c = F.least(F.lit(1.0), n / 5.0) * 0.4 + F.least(F.lit(1.0), points / 3.0) * 0.4 + variety * 0.2
    return T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.round(c, 9).alias("confidence"))


@query("flt10_filter_values", "SELECT page_id, nullif(replace(replace(url, ';', ''), '--', ''), '') AS value FROM pages")
def flt10(spark, sf_dir):
    plain = F.replace(F.replace(F.col("url"), F.lit(";"), F.lit("")), F.lit("--"), F.lit(""))
    return T.table(spark, sf_dir, "pages").select("page_id", F.nullif(plain, F.lit("")).alias("value"))


@query("mth06_usable_distances", "SELECT event_id, least(1.0, greatest(0.0, value)) AS distance FROM events")
def mth06_distance(spark, sf_dir):
    return T.table(spark, sf_dir, "events").select("event_id", evaluate.distance(F.col("value")).alias("distance"))
