"""Queries of the store's definition and upkeep, of delivery rules, sources and limits."""

from __future__ import annotations

import functools
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, setting
from ..functions import text as tx
from ..operators import analyze, delivery, limits, maintenance, providers, store, stores, synthesize
from ..operators.mergetable import MergeTable
from ..operators.search import vector_candidates
from ..operators.textindex import TextIndex
from ..paths import scratch, write_text
from ..schema import CHUNKS
from ..sources import discovery, readers
from ..streaming import cursors, jobs
from ..streaming import delivery as delivery_jobs
from ..streaming.source import AppendedLines
from . import tables as T
from .registry import query
from .search import QUESTION, _near_sql, _Q, hybrid, probe_vector

C, E = T.CHUNKS_SQL, T.ENTRIES_SQL


def _lines(spark, sf_dir):
    return T.entries(spark, sf_dir).select(F.col("session_id").alias("file"), "line")


# --- definition and upkeep ---


def _full(spark, sf_dir):
    """The chunks with all columns of the table."""
    c = T.chunks(spark, sf_dir)
    return c.select(*[(F.col(f.name) if f.name in c.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNKS])


@query("snk01_append_validated", f"WITH {C} SELECT id, session_id, md5(content) AS content_md5, len(vector) AS n FROM chunks WHERE vector IS NOT NULL")
def snk01(spark, sf_dir):
    path = scratch(spark, "appended")
    store.append(_full(spark, sf_dir).where("vector IS NOT NULL"), path, 64)
    return spark.read.parquet(path).select("id", "session_id", F.md5("content").alias("content_md5"), F.size("vector").cast("long").alias("n"))


@query("snk09_snk10_optimised_table", f"WITH {C} SELECT id, project_name, CAST(epoch_us(timestamp) AS BIGINT) AS us, md5(CASE WHEN doc_id % 40 = 0 THEN 'changed ' || content ELSE content END) AS content_md5, CAST(len(regexp_extract_all(lower(content), '[\\pL\\pN_]+')) AS BIGINT) AS n_words FROM chunks WHERE doc_id % 90 <> 7")
def snk09(spark, sf_dir):
    """A table after writes, changes and deletes, an upkeep and a second one; beside each row its length from the text index of the first."""
    held, indexes = MergeTable(spark, scratch(spark, "to-optimise"), cluster=("project_name", "timestamp")), scratch(spark, "indexes")
    c = T.chunks(spark, sf_dir)
    held.upsert(c.withColumn("seq", F.lit(0)))
    maintenance.optimise(held, indexes)
    held.upsert(c.where("doc_id % 40 = 0").withColumns({"content": F.concat(F.lit("changed "), "content"), "seq": F.lit(1)}))
    held.delete(c.where("doc_id % 90 = 7").select("id"))
    maintenance.optimise(held, indexes)
    lengths = TextIndex(spark, f"{indexes}/text-index").lengths().select("id", F.col("n").cast("long").alias("n_words"))
    return held.read().join(lengths, "id").select("id", "project_name", F.unix_micros("timestamp").alias("us"), F.md5("content").alias("content_md5"), "n_words")


_FIELDS = ", ".join(f"('{f.name}', '{f.dataType.simpleString()}')" for f in sorted(CHUNKS, key=lambda f: f.name))


@query("snk11_snk14_table_definition", f"WITH {C}, f(name, type) AS (VALUES {_FIELDS}) SELECT chunk_type, count(*) AS n, (SELECT string_agg(name || ' ' || type, ', ' ORDER BY name) FROM f) AS fields FROM chunks GROUP BY chunk_type")
def snk11(spark, sf_dir):
    """Defining the table twice is a success twice; then the chunks go into it."""
    name = f"palimpsest_{scratch(spark, 't').rsplit('-', 1)[1]}"
    path = scratch(spark, "defined")
    if not maintenance.define_table(spark, name, path) or maintenance.define_table(spark, name, path):
        raise ValueError("a definition must create a table once")
    fields = ", ".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in spark.table(name).schema))
    _full(spark, sf_dir).write.mode("append").partitionBy("chunk_type").bucketBy(16, "id").sortBy("id").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return spark.read.schema(CHUNKS).parquet(path).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("n")).select("chunk_type", "n", F.lit(fields).alias("fields"))


@query("snk11_secondary_indexes", f"WITH {C} SELECT 'session_id' AS indexed, session_id AS value, id FROM chunks UNION ALL SELECT 'project_path', project_path, id FROM chunks UNION ALL SELECT 'file_path', file_path, id FROM chunks WHERE file_path IS NOT NULL UNION ALL SELECT 'timestamp', CAST(epoch_us(timestamp) AS VARCHAR), id FROM chunks")
def snk11_indexes(spark, sf_dir):
    path = scratch(spark, "secondary")
    value = lambda c: F.unix_micros(c).cast("string") if c == "timestamp" else F.col(c)
    parts = [spark.read.parquet(f"{path}/{c}").select(F.lit(c).alias("indexed"), value(c).alias("value"), "id") for c in maintenance.secondary_indexes(T.chunks(spark, sf_dir), path)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("snk12_vector_index", f"WITH {C} SELECT id, chunk_type, session_id, project_name, machine_id, sha256(array_to_string(list_transform(vector, lambda x: CAST(CAST(round(x * 1048576) AS BIGINT) AS VARCHAR)), ',')) AS vector_sha FROM chunks WHERE vector IS NOT NULL")
def snk12(spark, sf_dir):
    """Every chunk with a vector is in the index once, with its vector and the stored columns."""
    numbers = F.array_join(F.transform("vector", lambda x: F.round(x.cast("double") * 1048576).cast("long").cast("string")), ",")
    return T.vector_index(spark, sf_dir).rows().select("id", "chunk_type", "session_id", "project_name", "machine_id", F.sha2(numbers, 256).alias("vector_sha"))


def _letter_counts(texts: list[str]) -> list[list[float]]:
    """A model whose vectors SQL can check: characters, letters a and spaces of a text."""
    return [[float(len(t)), float(t.count("a")), float(t.count(" "))] for t in texts]


_LETTERS = "CAST(length(content) AS BIGINT) AS n_chars, CAST(length(content) - length(replace(content, 'a', '')) AS BIGINT) AS n_a, CAST(length(content) - length(replace(content, ' ', '')) AS BIGINT) AS n_spaces"


def _shown_letters(v: str):
    return [F.col(v)[i].cast("long").alias(n) for i, n in enumerate(("n_chars", "n_a", "n_spaces"))]


@query("snk13_udf05_model_in_sql", f"WITH {C} SELECT id, {_LETTERS} FROM chunks WHERE vector IS NULL")
def snk13(spark, sf_dir):
    providers.register_model(spark, "count_letters", _letter_counts)
    T.chunks(spark, sf_dir).where("vector IS NULL").select("id", "content").createOrReplaceTempView("palimpsest_to_embed")
    return spark.sql("SELECT id, count_letters(content) AS v FROM palimpsest_to_embed").select("id", *_shown_letters("v"))


@query("snk17_cursor_state", f"WITH {E} SELECT session_id AS file, max(line) AS position FROM entries GROUP BY 1")
def snk17(spark, sf_dir):
    """A save that fails leaves the state before it; positions never go back."""
    state = cursors.CursorFile(spark, scratch(spark, "cursor-state"))
    rows = _lines(spark, sf_dir).groupBy("file").agg(F.max("line").alias("position"))
    state.save({r["file"]: 1 for r in rows.select("file").toLocalIterator()})
    try:
        state.save({"broken": object()})  # type: ignore[dict-item]
    except TypeError:
        pass
    now = state.advance({r["file"]: r["position"] for r in rows.toLocalIterator()})
    state.advance(dict.fromkeys(now, 0))
    path = scratch(spark, "cursor-rows")
    write_text(spark, f"{path}/rows.json", "\n".join(json.dumps({"file": f, "position": p}) for f, p in state.load().items()))
    return spark.read.schema("file string, position long").json(path)


@query("udf01_snk19_store_by_setting", f"WITH {C} SELECT id, machine_id, md5(CASE WHEN doc_id % 10 = 0 THEN 'changed' ELSE content END) AS content_md5, max(source_line) OVER (PARTITION BY source_file) AS position FROM chunks WHERE machine_id <> 'machine-2'")
def udf01(spark, sf_dir):
    """A store that a setting names: append, delete a machine, upsert; then its rows and the positions of their files."""
    held = stores.open_store(spark, "versioned", scratch(spark, "versions"))
    held.append(T.chunks(spark, sf_dir))
    held.delete_machine("machine-2")
    held.upsert(held.table().where("doc_id % 10 = 0").withColumns({"content": F.lit("changed"), "seq": F.lit(1)}))
    return held.table().join(held.positions(), "source_file").select("id", "machine_id", F.md5("content").alias("content_md5"), "position")


@query("prj21_mutation_values", f"WITH {C} SELECT id, md5(content) AS content_md5, source_line, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS timestamp, coalesce(len(vector), 0) AS n FROM chunks")
def prj21(spark, sf_dir):
    v = maintenance.mutation_values(T.chunks(spark, sf_dir))
    return v.select("id", F.md5("content").alias("content_md5"), "source_line", "timestamp", F.size("vector").cast("long").alias("n"))


# --- models ---


@query("udf02_udf03_udf04_providers", f"WITH {C} SELECT kind, id, {_LETTERS} FROM chunks, (VALUES ('plain'), ('indexed'), ('single')) k(kind) WHERE vector IS NULL")
def udf02(spark, sf_dir):
    """Three kinds of service give each text its own vector, in whatever order they answer."""
    kinds = {"plain": _letter_counts, "indexed": providers.IndexedProvider(lambda texts: list(enumerate(_letter_counts(texts)))[::-1], 3), "single": providers.SingleProvider(lambda t, task: _letter_counts([t])[0], 3)}
    c = T.chunks(spark, sf_dir).where("vector IS NULL").select("id", "content")
    a, b, d = (providers.embedded(c, model).select(F.lit(kind).alias("kind"), "id", *_shown_letters("vector")) for kind, model in kinds.items())
    return a.unionByName(b).unionByName(d)


@query("udf08_custom_patterns", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS w FROM documents) SELECT doc_id, list_contains(w, 'und') AS tech, list_contains(w, 'the') AS intent FROM w")
def udf08(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    low = F.lower("text")
    techs = analyze.technologies(low, {"conjunction": ["und"]})
    return d.select("doc_id", (F.size(techs) > 0).alias("tech"), (analyze.intent_counts(low, {"article": [r"\bthe\b"]})["article"] > 0).alias("intent"))


@query("udf09_udf10_settings", f"WITH g AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'search_limit' WHEN 1 THEN 'cache_seconds' ELSE 'refine' END AS name, CASE event_id % 7 WHEN 0 THEN 'soon' WHEN 1 THEN '-3' WHEN 2 THEN 'yes' WHEN 3 THEN '' ELSE CAST(event_id AS VARCHAR) END AS raw FROM events) SELECT event_id, name, CASE name WHEN 'search_limit' THEN CASE WHEN try_cast(raw AS BIGINT) >= 0 THEN CAST(try_cast(raw AS BIGINT) AS VARCHAR) ELSE '{Config.search_limit}' END WHEN 'cache_seconds' THEN CASE WHEN try_cast(raw AS DOUBLE) >= 0 THEN CAST(try_cast(raw AS BIGINT) AS VARCHAR) || '.0' ELSE '{Config.cache_seconds}' END ELSE CASE WHEN lower(raw) IN ('1', 'true', 'yes') THEN 'True' ELSE 'False' END END AS value FROM g")
def udf09(spark, sf_dir):
    """Settings that machines report, each read as its field wants; values that do not parse, or are negative, fall back to the default."""
    n = F.col("event_id")
    name = F.when(n % 3 == 0, "search_limit").when(n % 3 == 1, "cache_seconds").otherwise("refine")
    raw = F.when(n % 7 == 0, "soon").when(n % 7 == 1, "-3").when(n % 7 == 2, "yes").when(n % 7 == 3, "").otherwise(n.cast("string"))
    return T.table(spark, sf_dir, "events").select("event_id", name.alias("name"), setting(name, raw).alias("value"))


# --- delivery ---

_IV = f"""WITH {E}, p AS (SELECT session_id AS file, uline AS user_line, line FROM (SELECT *, lag(role) OVER w AS prev, lag(line) OVER w AS uline FROM entries WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY line)) WHERE role = 'assistant' AND prev = 'user'),
iv AS (SELECT 'c' || conv_id AS file, CAST(conv_id * 7 % 5 AS BIGINT) AS s, CAST(CASE WHEN conv_id % 11 = 0 THEN conv_id * 7 % 5 - 1 ELSE conv_id * 7 % 5 + conv_id % 6 END AS BIGINT) AS e FROM (SELECT DISTINCT conv_id FROM conversations)),
h AS (SELECT file, arg_max(role, line) AS role, max(line) AS line FROM iv JOIN entries ON session_id = file AND line <= e WHERE role IN ('user', 'assistant') GROUP BY file),
x AS (SELECT file, s, e, least(s, min(greatest(user_line - 1, 0)) FILTER (user_line <= s AND s < line)) AS safe_start, least(e, min(greatest(user_line - 1, 0)) FILTER (user_line <= e AND e < line)) AS paired_end FROM iv LEFT JOIN p USING (file) WHERE e >= s GROUP BY file, s, e),
y AS (SELECT file, s, greatest(safe_start, least(paired_end, CASE WHEN role = 'user' THEN h.line - 1 ELSE e END)) AS safe_end FROM x LEFT JOIN h USING (file))"""


@query("stm07_expanded_intervals", f"{_IV} SELECT file, user_line, line, safe_end, NULL::VARCHAR AS error FROM y JOIN p USING (file) WHERE line > s AND line <= safe_end UNION ALL SELECT file, NULL, NULL, NULL, 'regressive boundary' FROM iv WHERE e < s")
def stm07(spark, sf_dir):
    """Boundaries anywhere in the conversations: no pair is split."""
    n = F.col("conv_id")
    wanted = T.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    start = n * 7 % 5
    wanted = wanted.select(F.concat(F.lit("c"), n.cast("string")).alias("session_id"), start.cast("long").alias("start_exclusive"), F.when(n % 11 == 0, start - 1).otherwise(start + n % 6).cast("long").alias("end_inclusive"))
    return delivery.expanded(T.entries(spark, sf_dir), wanted)


@query("stm09_ordered_delivery", "WITH r AS (SELECT 'f' || (user_id % 40) AS file, event_id AS seq FROM events) SELECT file, seq, CASE WHEN seq % 389 = 17 THEN 3 ELSE 1 END AS tries FROM (SELECT *, min(seq) FILTER (seq % 997 = 5) OVER (PARTITION BY file) AS stuck FROM r) WHERE stuck IS NULL OR seq < stuck")
def stm09(spark, sf_dir):
    """Two runs: in the first the server is down from the middle record on, the second goes on from its state.

    Some records are blocked twice, some for ever; the latter hold up their own files only.
    """
    e = T.table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("file"), F.col("event_id").alias("seq"))
    middle = e.agg(F.max("seq")).first()[0] // 2
    inbox, (target, offsets) = scratch(spark, "outbox"), jobs.places(spark, "delivered")

    def sender(down_from):
        def send(file: str, seq: int, tries: int) -> str:
            if seq >= down_from:
                return "down"
            return "blocked" if seq % 997 == 5 or (seq % 389 == 17 and tries < 3) else "ok"

        return send

    for part, down_from in ((F.col("seq") <= middle, middle // 2), (F.col("seq") > middle, 2**62)):
        e.where(part).write.mode("append").parquet(inbox)
        delivery_jobs.deliver_to(spark.readStream.schema(e.schema).parquet(inbox), target, offsets, sender(down_from), partitions=4)
    return spark.read.schema("file string, seq long, tries int").parquet(target)


def _embedding_that_fails(texts: list[str]) -> list[list[float]]:
    if any("unreadable" in t for t in texts):
        raise ValueError("a text can't be embedded")
    return store.hashed_vectors(16)(texts)


@query("stm10_snk17_acknowledged_uploads", "WITH u AS (SELECT event_type AS file, event_id // 50 AS upload, max(event_id) AS e, count(*) AS n, count(*) FILTER (event_id % 503 <> 7) AS m FROM events GROUP BY ALL) SELECT file, max(e) AS position, CAST(sum(n) AS BIGINT) AS stored, CAST(sum(n) AS BIGINT) AS embedded FROM u WHERE n = m GROUP BY file")
def stm10(spark, sf_dir):
    """Uploads with a text that can't be embedded leave nothing behind and don't move their file."""
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.expr("event_id div 50").alias("upload"), "event_id")
    counts = e.groupBy("file", "upload").agg(F.max("event_id").alias("end"), F.count(F.lit(1)).alias("n"))
    inbox, (target, offsets) = scratch(spark, "uploads"), jobs.places(spark, "acknowledged")
    content = F.when(F.col("event_id") % 503 == 7, "unreadable").otherwise(F.concat(F.lit("event "), F.col("event_id").cast("string")))
    rows = e.join(counts, ["file", "upload"]).select("upload", "file", "end", "n", F.col("event_id").cast("string").alias("id"), content.alias("content"))
    rows.repartition(4, "upload").write.parquet(inbox)  # an upload is one request: its chunks are in one file
    delivery_jobs.uploads_to(spark.readStream.schema(rows.schema).parquet(inbox), target, offsets, _embedding_that_fails)
    chunks, cursors = delivery_jobs.upload_tables(spark, target)
    held = chunks.read().groupBy("file").agg(F.count(F.lit(1)).alias("stored"), F.count("vector").alias("embedded"))
    return cursors.read().join(held, "file").select("file", "position", "stored", "embedded")


@query("stm01_stm02_appended_lines", f"WITH {E} SELECT session_id, line, md5(text) AS text_md5 FROM entries")
def stm01(spark, sf_dir):
    """Conversations as logs, read by the source of appended lines: at most 4 MB and 100 files in a batch, 256 KB in a task, until nothing is left."""
    target, offsets = jobs.places(spark, "appended-lines")
    spark.dataSource.register(AppendedLines)
    logs = scratch(spark, "logs")
    T.entries(spark, sf_dir).select(F.to_json(F.struct("session_id", "line", "text")).alias("value")).write.text(logs)
    lines = spark.readStream.format("appended_lines").options(path=f"{logs}/*.txt", progress=f"{offsets}-progress", maxBytesPerTrigger=4 << 20, maxFilesPerTrigger=100, partBytes=1 << 18).load()
    read = lines.select(F.from_json("text", "session_id string, line long, text string").alias("r")).select("r.session_id", "r.line", F.md5("r.text").alias("text_md5"))
    jobs.drained(read.writeStream.format("parquet").option("path", target), offsets)
    return spark.read.schema("session_id string, line long, text_md5 string").parquet(target)


@query("stm15_stm16_periodic_jobs", f"WITH {C} SELECT id, true AS embedded, md5(content) AS content_md5 FROM chunks")
def stm15(spark, sf_dir):
    """Two turns of the backfill and of the upkeep over a table with missing vectors: the table after them."""
    held, indexes = stores.VersionedStore(spark, scratch(spark, "periodic")), scratch(spark, "periodic-indexes")
    held.append(T.chunks(spark, sf_dir))
    jobs.periodic(spark, lambda: held.backfill(store.hashed_vectors(64)), 0.2, 2, scratch(spark, "backfill-ticks"))
    jobs.periodic(spark, lambda: maintenance.optimise(held.held, indexes), 0.2, 2, scratch(spark, "upkeep-ticks"))
    return held.table().select("id", F.col("vector").isNotNull().alias("embedded"), F.md5("content").alias("content_md5"))


@query("stm20_full_reindex", "SELECT count(DISTINCT doc_id % 300) AS first, count(DISTINCT doc_id % 300) AS again FROM documents")
def stm20(spark, sf_dir):
    from .streams import _stream

    target, offsets = jobs.places(spark, "reindexed")

    def run():
        jobs.upsert_to(_stream(spark, sf_dir, "documents").select((F.col("doc_id") % 300).alias("id"), "doc_id"), target, offsets, order=("doc_id",))

    run()
    first = jobs.latest_version(spark, target, order=("doc_id",)).count()
    maintenance.reindexed(spark, target, offsets, run)
    return jobs.latest_version(spark, target, order=("doc_id",)).agg(F.lit(first).cast("long").alias("first"), F.count(F.lit(1)).alias("again"))


# --- sources ---

_FILES = ["logs/a.jsonl", "logs/transcript_full.jsonl", "b/chats/one.json", "b/chats/deep/two.json", "b/logs.json", "x/conversations.json", "x/conversations/p.pb", "x/conversations/p.txt", "notes.md", "conversations.json"]
_PATHS_SQL = ", ".join(f"('{s}', '{p}')" for s, p in discovery.PATHS.items())


@query("src11_src12_src13_discovered_files", f"WITH f(file) AS (VALUES {', '.join(f'({chr(39)}{f}{chr(39)})' for f in _FILES)}), s(kind, pattern) AS (VALUES {_PATHS_SQL}) SELECT kind AS source, d.source || '/' || file AS path FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) d, f, s WHERE regexp_matches(file, pattern)")
def src11(spark, sf_dir):
    """Every source of the documents has a folder of files; each reader finds its own."""
    root = scratch(spark, "discover")
    for r in T.table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct().toLocalIterator():
        for f in _FILES:
            write_text(spark, f"{root}/{r['source']}/{f}", "x")
    name = root.rsplit("/", 1)[1]
    found = [discovery.discovered(spark, root, s).select(F.lit(s).alias("source"), F.substring_index("path", f"{name}/", -1).alias("path")) for s in discovery.PATHS]
    return functools.reduce(DataFrame.unionByName, found)


_INSIDE = [(0, "/logs/a§/b.jsonl"), (1, "/logs/../§/p.jsonl"), (2, "/logsx/§.jsonl"), (3, "/logs"), (4, "/logs/..§/b.jsonl")]


@query("src11_contained_paths", f"WITH {T.varied_sql('p', 'i, f', _INSIDE)} SELECT i, starts_with(f, '/logs/') AND NOT list_contains(string_split(f, '/'), '..') AS ok FROM p")
def src11_inside(spark, sf_dir):
    return T.varied(spark, sf_dir, "i, f", _INSIDE).select("i", discovery.inside(F.col("f"), "/logs/").alias("ok"))


@query("src10_landed_uploads", f"WITH {C}, p AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY doc_id) - 1) // 3 AS part FROM chunks), u AS (SELECT session_id, part, count(*) AS n FROM p GROUP BY ALL) SELECT p.id, session_id || '-' || part AS upload_id, md5(content) AS content_md5, NULL::VARCHAR AS refused FROM p UNION ALL SELECT NULL, session_id || '-all', NULL, 'too many chunks' FROM (SELECT DISTINCT session_id FROM chunks)")
def src10(spark, sf_dir):
    """Whole chunks land in uploads of three; beside them each session is sent once with a chunk 501 times, which is refused."""
    landing, (target, offsets) = scratch(spark, "landing"), jobs.places(spark, "landed")
    c = T.chunks(spark, sf_dir)
    chunk = F.struct("id", "content", "source_file", "source_line")
    order = Window.partitionBy("session_id").orderBy("doc_id")
    placed = c.withColumn("part", F.floor((F.row_number().over(order) - 1) / 3).cast("long"))
    small = placed.groupBy("session_id", "part").agg(F.collect_list(chunk).alias("chunks")).select(F.concat("session_id", F.lit("-"), F.col("part").cast("string")).alias("upload_id"), F.lit("m").alias("machine_id"), "chunks")
    short = F.struct(F.col("id"), F.lit("c").alias("content"), "source_file", "source_line")
    large = c.groupBy("session_id").agg(F.min(short).alias("one")).select(F.concat("session_id", F.lit("-all")).alias("upload_id"), F.lit("m").alias("machine_id"), F.array_repeat("one", 501).alias("chunks"))
    small.unionByName(large).select(F.to_json(F.struct("upload_id", "machine_id", "chunks")).alias("value")).write.text(landing)
    discovery.landed(spark, landing).writeStream.format("parquet").option("path", target).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("upload_id string, refused string, id string, content string").parquet(target)
    return told.select("id", "upload_id", F.md5("content").alias("content_md5"), "refused")


_READ = [
    ("primary", '{"type":"user","sessionId":"s","message":{"content":"plain §"}}', "plain §"), ("codex", '{"type":"event_msg","payload":{"type":"user_message","message":"more §"}}', "more §"),
    ("gemini", '{"sessionId":"g§","messages":[{"type":"user","content":"q §"}]}', "q §"), ("antigravity", '{"type":"PLAN","thinking":"hm §"}', "Source: unknown\n\nType: PLAN\n\nStatus: unknown\n\nThinking:\nhm §"),
    ("antigravity_binary", "b §", "b §"), ("chatgpt", '[{"id":"k§","messages":[{"role":"user","content":"x §"}]}]', "x §"), ("claude_app", '[{"uuid":"u§","messages":[{"sender":"human","text":"hi §"}]}]', "hi §"),
]


@query("src14_udf06_readers", T.expected_sql("source_kind, text", [(k, s, told) for k, (s, _, told) in enumerate(_READ)], len(_READ)).replace("source_kind", "kind"))
def src14(spark, sf_dir):
    """Every document is a file of one of the seven sources, read by the reader that its source names."""
    files = T.varied(spark, sf_dir, "line, kind, content", [(k, s, content) for k, (s, content, _) in enumerate(_READ)])
    files = files.withColumn("path", F.concat(F.lit("/h/"), F.col("line").cast("string"), F.lit("/conversations.json")))
    out = []
    for kind, read in readers.READERS.items():
        own = files.where(F.col("kind") == kind)
        if kind in ("primary", "codex", "antigravity"):
            rows = read(own.select("path", F.col("line").cast("long").alias("line"), F.col("content").alias("text")))
        elif kind == "antigravity_binary":
            rows = read(own.select("path", F.encode("content", "utf-8").alias("bytes")))
        else:
            rows = read(own.select("path", "content"), kind) if kind in ("chatgpt", "claude_app") else read(own.select("path", "content"))
        out.append(rows.select(F.lit(kind).alias("kind"), "text"))
    return functools.reduce(DataFrame.unionByName, out)


@query("dat07_modification_time", "SELECT count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS fallen_back FROM documents")
def dat07(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.timestamp_micros(F.col("doc_id"))).alias("ts"), F.col("_metadata.file_modification_time").alias("modified"))
    timed = discovery.with_fallback_time(d, "ts", F.col("modified"))
    return timed.agg(F.count("ts").alias("n"), F.count_if(F.col("ts") == F.col("modified")).alias("fallen_back"))


# --- limits, over-fetching, synthesis ---


@query("flt20_flt21_request_bounds", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty question' WHEN length(text) > 512 THEN 'question too long' WHEN doc_id % 130 NOT BETWEEN 1 AND 100 THEN 'limit out of range' END AS http, CASE WHEN trim(text) = '' THEN 'empty question' WHEN length(text) > 10000 THEN 'question too long' WHEN doc_id % 130 NOT BETWEEN 1 AND 50 THEN 'limit out of range' END AS tool, least(greatest(doc_id % 30, 1), 20) AS n FROM documents")
def flt20(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    limit = F.col("doc_id") % 130
    return d.select("doc_id", limits.request_error(F.col("text"), limit, "http").alias("http"), limits.request_error(F.col("text"), limit, "tool").alias("tool"), limits.clamped(F.col("doc_id") % 30).alias("n"))


@query("top06_overfetched", f"WITH {C}, {_Q}, n AS ({_near_sql('true', 60)}) SELECT c.id, n.distance AS score FROM chunks c JOIN n USING (id) WHERE chunk_type = 'turn' ORDER BY 2, 1 LIMIT 20")
def top06(spark, sf_dir):
    """Three times the limit is fetched, then filtered, then cut."""
    c = T.chunks(spark, sf_dir)
    best = vector_candidates(c, probe_vector(spark, sf_dir), 3 * 20).withColumnRenamed("distance", "score")
    return c.join(F.broadcast(best), "id").where("chunk_type = 'turn'").orderBy("score", "id").limit(20).select("id", "score")


@query("top11_shown_elements", "WITH q AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS l FROM documents) SELECT doc_id, array_to_string(l[1:10], ' ') AS terms, array_to_string(l[1:3], ' ') AS suggestions, array_to_string(l[1:5], ' ') AS points FROM q")
def top11(spark, sf_dir):
    words = T.table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("l"))
    return words.select("doc_id", *[F.array_join(limits.shown(F.col("l"), k), " ").alias(k) for k in ("terms", "suggestions", "points")])


def _synthesized(spark, sf_dir):
    results = hybrid(spark, sf_dir).select(F.lit(0).alias("qid"), "id", "content", "score", "chunk_type", "session_id", "file_path", "operation", F.array().cast("array<string>").alias("techs"), tx.lit_list(QUESTION.split()).alias("terms"))
    return synthesize.synthesized(results)


@query("syn03_key_points")
def syn03(spark, sf_dir):
    return _synthesized(spark, sf_dir).select(F.posexplode(F.split("key_points", "\n")).alias("nth", "point"))


@query("syn04_primary_content")
def syn04(spark, sf_dir):
    return _synthesized(spark, sf_dir).select("qid", "primary_content", "n_snippets")


@query("win12_bounded_look_back")
def win12(spark, sf_dir):
    """Results kept after a comparison with the last ten kept."""
    return _synthesized(spark, sf_dir).select("n_unique", "deduplication_count", "method")
