"""Rollups of heartbeats, errors, latencies, cursors and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups
from . import tables
from .registry import query

T = tables


def _events(spark, sf_dir):
    return T.table(spark, sf_dir, "events")


def _machine():
    return F.concat(F.lit("m"), (F.col("user_id") % 20).cast("string"))


_M = "'m' || (user_id % 20)"


@query("agg05_new_positions", f"WITH {T.CHUNKS_SQL} SELECT source_file, greatest(max(source_line), count(*)) AS position FROM chunks GROUP BY 1")
def agg05(spark, sf_dir):
    return T.chunks(spark, sf_dir).groupBy("source_file").agg(F.greatest(F.max("source_line"), F.count(F.lit(1))).alias("position"))


@query("agg06_stm19_monotone_cursors", f"SELECT event_id, {_M} AS machine, max(event_id % 1000) OVER (PARTITION BY {_M} ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cursor FROM events")
def agg06(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", _machine().alias("machine"), (F.col("event_id") % 1000).alias("position"))
    return rollups.monotone(e, ["machine"], "event_id", "position").select("event_id", "machine", F.col("position").alias("cursor"))


@query("agg07_win09_latencies", f"SELECT event_id, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY {_M} ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean_cents FROM events")
def agg07(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", _machine().alias("machine"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rollups.rolling_mean(e, ["machine"], "event_id", "cents", 100).select("event_id", F.col("mean").alias("mean_cents"))


@query("agg07_queries_a_minute", f"SELECT {_M} AS machine, round(count(*) / greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0), 9) AS per_minute FROM events GROUP BY 1")
def agg07_rate(spark, sf_dir):
    e = _events(spark, sf_dir)
    minutes = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 60_000_000.0
    return e.groupBy(_machine().alias("machine")).agg(F.round(F.count(F.lit(1)) / F.greatest(F.lit(1.0), minutes), 9).alias("per_minute"))


@query("agg08_errors_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg08(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg08_recent_errors", f"SELECT machine, event_id FROM (SELECT {_M} AS machine, event_id, row_number() OVER (PARTITION BY {_M} ORDER BY event_id DESC) AS nth FROM events WHERE event_type = 'error') WHERE nth <= 50")
def agg08_recent(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_type = 'error'").select(_machine().alias("machine"), "event_id")
    return rollups.latest(e, ["machine"], "event_id", 50)


@query("agg09_queue_rollup", f"""SELECT {_M} AS machine, min(epoch_us(ts)) AS oldest, CAST(sum(event_id % 4) AS BIGINT) AS retries, count(*) FILTER (event_id % 4 > 0) AS retried, count(*) FILTER (event_id % 4 = 3) AS blocked FROM events GROUP BY 1""")
def agg09(spark, sf_dir):
    e = _events(spark, sf_dir).select(_machine().alias("machine"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 4).alias("retry_count"))
    return rollups.queue(e).select("machine", F.unix_micros("oldest").alias("oldest"), "retries", "retried", "blocked")


@query("agg09_failure_reasons", "SELECT event_type AS reason, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS age FROM events WHERE event_id % 4 = 3 GROUP BY 1")
def agg09_reasons(spark, sf_dir):
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return _events(spark, sf_dir).where("event_id % 4 = 3").groupBy(F.col("event_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"), (F.max(ts) - F.min(ts)).alias("age"))


_CHECK = "CASE WHEN event_id % 97 = 0 THEN 'error' WHEN event_id % 13 = 0 THEN 'degraded' ELSE 'ok' END"


@query("agg10_health", f"SELECT user_id % 500 AS unit, CASE WHEN bool_and({_CHECK} = 'ok') THEN 'healthy' WHEN bool_or({_CHECK} = 'error') THEN 'unhealthy' ELSE 'degraded' END AS status FROM events GROUP BY 1")
def agg10(spark, sf_dir):
    n = F.col("event_id")
    check = F.when(n % 97 == 0, "error").when(n % 13 == 0, "degraded").otherwise("ok")
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 500).alias("unit")).agg(rollups.health(check).alias("status"))


@query("agg11_agg18_qry14_source_sums", "SELECT count(DISTINCT event_type) AS sources, CAST(sum(event_id % 3) AS BIGINT) AS indexed, count(*) FILTER (event_id % 5 = 0) AS pending, count(*) FILTER (event_id % 7 = 0) AS failed FROM events")
def agg11(spark, sf_dir):
    n = F.col("event_id")
    return _events(spark, sf_dir).agg(F.count_distinct("event_type").alias("sources"), F.sum(n % 3).alias("indexed"), F.count_if(n % 5 == 0).alias("pending"), F.count_if(n % 7 == 0).alias("failed"))


@query("agg15_win11_embed_rate", f"""WITH s AS (SELECT {_M} AS machine, event_id, epoch_us(ts) AS t, event_id % 500 AS embedded, lag(event_id % 500) OVER w AS pe, lag(epoch_us(ts)) OVER w AS pt FROM events WINDOW w AS (PARTITION BY {_M} ORDER BY ts, event_id)),
r AS (SELECT *, CASE WHEN t - pt >= 1000000 AND embedded > pe THEN (embedded - pe) / ((t - pt) / 1000000.0) * 60 END AS rate FROM s) SELECT event_id, rate, (500 - embedded) / (rate / 60) AS eta FROM r""")
def agg15(spark, sf_dir):
    e = _events(spark, sf_dir).select(_machine().alias("machine"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 500).alias("embedded"))
    rated = rollups.rates(e, ["machine"], ["ts", "event_id"], F.lit(500) - F.col("embedded"))
    return rated.select("event_id", "rate", "eta")


@query("agg16_hit_rate", f"SELECT {_M} AS machine, round(coalesce(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'view')), 0), 0), 9) AS hit_rate FROM events GROUP BY 1")
def agg16(spark, sf_dir):
    hits, both = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type").isin("click", "view"))
    return _events(spark, sf_dir).groupBy(_machine().alias("machine")).agg(F.round(F.coalesce(F.try_divide(hits.cast("double"), both.cast("double")), F.lit(0.0)), 9).alias("hit_rate"))


@query("agg17_stale_uploads", f"SELECT {_M} AS machine, count(*) FILTER (epoch_us(m) - epoch_us(ts) >= 259200000000) AS stale FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1")
def agg17(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.agg(F.max("ts")).first()[0]
    return e.groupBy(_machine().alias("machine")).agg(rollups.stale(F.col("ts"), F.lit(now)).alias("stale"))


@query("win06_first_of_session", f"WITH {T.CHUNKS_SQL} SELECT session_id, id FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY length(content), id) AS nth FROM chunks) WHERE nth = 1")
def win06(spark, sf_dir):
    from ..operators.synthesize import first_of

    c = T.chunks(spark, sf_dir).select("session_id", "id", F.length("content").alias("n"))
    return first_of(c, ["session_id"], ["n", "id"]).select("session_id", "id")


@query("win07_first_operation_of_file", f"WITH {T.CHUNKS_SQL} SELECT file_path, operation, id FROM (SELECT file_path, operation, id, row_number() OVER (PARTITION BY file_path, operation ORDER BY source_line) AS nth FROM chunks WHERE file_path IS NOT NULL) WHERE nth = 1")
def win07(spark, sf_dir):
    from ..operators.synthesize import first_of

    c = T.chunks(spark, sf_dir).where("file_path IS NOT NULL").select("file_path", "operation", "id", "source_line")
    return first_of(c, ["file_path", "operation"], ["source_line"]).select("file_path", "operation", "id")


@query("win10_stm11_queue_heads", f"SELECT event_id FROM (SELECT event_id, min(event_id) OVER (PARTITION BY {_M}, event_type) AS head FROM events WHERE event_id % 3 > 0) WHERE event_id = head")
def win10(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_id % 3 > 0").select("event_id", _machine().alias("machine"), "event_type")
    return rollups.heads(e, ["machine", "event_type"], "event_id").select("event_id")


_NOW = "(SELECT max(ts) AS now FROM events)"
_LAST = f"SELECT user_id, max(ts) AS seen, max_by(event_type, struct_pack(t := ts, e := event_id)) AS kind FROM events GROUP BY 1"


@query("dat08_stm17_top08_clients", f"""WITH h AS ({_LAST}) SELECT user_id, kind, CASE WHEN epoch_us(now) - epoch_us(seen) > 300000000 THEN 'Disconnected' WHEN kind = 'error' THEN 'Degraded' ELSE 'OK' END AS label,
epoch_us(now) - epoch_us(seen) > 7 * 86400000000 AS stale, row_number() OVER (ORDER BY seen DESC NULLS LAST, user_id) AS place FROM h, {_NOW}""")
def dat08(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    now = e.agg(F.max("ts")).first()[0]
    last = rollups.last_heartbeats(e, "user_id", F.struct("ts", "event_id"), ["event_type", "ts"])
    labelled = rollups.client_labels(last.select("user_id", F.col("event_type").alias("kind"), F.col("ts").alias("seen")), F.lit(now))
    return rollups.placed(labelled, [F.desc_nulls_last("seen"), "user_id"]).select("user_id", "kind", "label", "stale", "place")


@query("map01_heartbeat_sections", "SELECT event_id, concat_ws(',', 'queued=' || event_id % 9, 'size=' || event_id) AS numbers FROM events")
def map01(spark, sf_dir):
    n = F.col("event_id").cast("string")
    m = F.create_map(F.lit("size"), n, F.lit("queued"), (F.col("event_id") % 9).cast("string"), F.lit("password"), F.lit("x"), F.lit("status"), F.lit("fine"))
    kept = rollups.numeric_section(m)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return _events(spark, sf_dir).select("event_id", shown.alias("numbers"))


_POS = f"SELECT 'f' || (event_id % 300) AS file, max(event_id) AS local FROM events GROUP BY 1"


@query("jon09_jon10_stm12_gaps", f"WITH l AS ({_POS}), s AS (SELECT 'f' || (event_id % 300) AS file, max(event_id) AS server FROM events WHERE event_id % 2 = 0 AND event_id % 300 < 200 GROUP BY 1), q AS (SELECT 'f' || (event_id % 300) AS file FROM events WHERE event_id % 300 BETWEEN 10 AND 20 GROUP BY 1) SELECT file, coalesce(server, 0) AS start_exclusive, local AS end_inclusive FROM l LEFT JOIN s USING (file) WHERE local > coalesce(server, 0) AND file NOT IN (SELECT file FROM q)")
def jon09(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.concat(F.lit("f"), (F.col("event_id") % 300).cast("string")).alias("file"), "event_id", (F.col("event_id") % 300).alias("k"))
    local = e.groupBy("file").agg(F.max("event_id").alias("local"))
    server = e.where("event_id % 2 = 0 AND k < 200").groupBy("file").agg(F.max("event_id").alias("server"))
    pending = e.where("k BETWEEN 10 AND 20").select("file").distinct()
    return rollups.gaps(local, server, pending)


@query("qry17_positions", f"SELECT event_type AS file, max(event_id) AS position FROM events WHERE {_M} = 'm3' GROUP BY 1")
def qry17(spark, sf_dir):
    return _events(spark, sf_dir).where(_machine() == "m3").groupBy(F.col("event_type").alias("file")).agg(F.max("event_id").alias("position"))


@query("flt18_stm13_generations", "SELECT event_id FROM events WHERE event_id % 6 = (SELECT max(event_id % 6) FROM events WHERE event_id < 4)")
def flt18(spark, sf_dir):
    e = _events(spark, sf_dir)
    current = e.where("event_id < 4").agg(F.max(F.col("event_id") % 6)).first()[0]
    return e.where(F.col("event_id") % 6 == current).select("event_id")


@query("stm14_reindex_required", f"WITH a AS (SELECT {_M} AS machine, bool_or(event_id % 17 = 0) AS done FROM events WHERE event_id % 2 = 0 GROUP BY 1), m AS (SELECT DISTINCT {_M} AS machine FROM events) SELECT machine, NOT coalesce(done, false) AS required FROM m LEFT JOIN a USING (machine)")
def stm14(spark, sf_dir):
    e = _events(spark, sf_dir).select(_machine().alias("machine"), "event_id")
    acks = e.where("event_id % 2 = 0").select("machine", F.when(F.col("event_id") % 17 == 0, "completed").otherwise("started").alias("status"))
    return rollups.reindex_required(e.select("machine").distinct(), acks)


@query("stm18_claims_once", "SELECT DISTINCT user_id % 50 AS file, event_id // 1000 AS start FROM events")
def stm18(spark, sf_dir):
    return _events(spark, sf_dir).select((F.col("user_id") % 50).alias("file"), F.expr("event_id div 1000").alias("start")).dropDuplicates(["file", "start"])


@query("snk18_prometheus", "WITH s AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS e, avg(value) AS v FROM events), l AS (SELECT unnest([('mcp_chunks_total', 'counter', CAST(n AS VARCHAR)), ('mcp_indexing_files_failed', 'gauge', CAST(e AS VARCHAR)), ('mcp_query_duration_seconds_avg', 'gauge', printf('%.6f', v / 1000)), ('mcp_health_status', 'gauge', '0.5')]) AS x FROM s) SELECT x[1] AS name, '# TYPE ' || x[1] || ' ' || x[2] || chr(10) || x[1] || ' ' || x[3] AS text FROM l")
def snk18(spark, sf_dir):
    s = _events(spark, sf_dir).agg(F.count(F.lit(1)).alias("mcp_chunks_total"), F.count_if(F.col("event_type") == "error").alias("mcp_indexing_files_failed"), F.avg("value").alias("latency"))
    s = s.select("mcp_chunks_total", "mcp_indexing_files_failed", (F.col("latency") / 1000).alias("mcp_query_duration_seconds_avg"), F.lit("degraded").alias("mcp_health_status"))
    return rollups.exposition(s).select("name", F.substring_index("text", "\n", -2).alias("text"))


_FRAGMENTS = """c AS (SELECT '/logs/m' || (doc_id % 3) AS f, doc_id % 50 + 1 AS line, doc_id AS seq, strlen(text) AS b, row_number() OVER (PARTITION BY doc_id % 3, doc_id % 50 ORDER BY doc_id) AS i FROM documents),
r AS (SELECT f, line, i, b, 1 AS rows, b AS bytes, 0 AS record FROM c WHERE i = 1 UNION ALL
      SELECT c.f, c.line, c.i, c.b, CASE WHEN r.rows + 1 > 8 OR r.bytes + c.b > 16384 THEN 1 ELSE r.rows + 1 END, CASE WHEN r.rows + 1 > 8 OR r.bytes + c.b > 16384 THEN c.b ELSE r.bytes + c.b END,
             CASE WHEN r.rows + 1 > 8 OR r.bytes + c.b > 16384 THEN r.record + 1 ELSE r.record END FROM r JOIN c ON c.f = r.f AND c.line = r.line AND c.i = r.i + 1),
l AS (SELECT f, line, coalesce(lag(line) OVER (PARTITION BY f ORDER BY line), 0) AS before FROM (SELECT DISTINCT f, line FROM c))"""


@query("stm08_upload_packing", f"WITH RECURSIVE {_FRAGMENTS}, g AS (SELECT f, line, CAST(record AS BIGINT) AS record, max(rows) AS n, CAST(max(bytes) AS BIGINT) AS bytes, max(record) OVER (PARTITION BY f, line) = record AS last FROM r GROUP BY f, line, record) SELECT f AS source_file, line, record, CAST(n AS BIGINT) AS rows, bytes, before AS start_position, CASE WHEN last THEN line ELSE before END AS position, last AS final_fragment, bytes > 16384 AS oversize FROM g JOIN l USING (f, line)")
def stm08(spark, sf_dir):
    """Documents as chunks of some lines of three logs, in records of at most eight chunks and 16 KiB."""
    from ..operators.chunking import packed_uploads

    n = F.col("doc_id")
    c = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("/logs/m"), (n % 3).cast("string")).alias("source_file"), (n % 50 + 1).alias("line"), n.alias("seq"), F.octet_length("text").cast("long").alias("bytes"))
    return packed_uploads(c, 8, 1 << 14)


@query("jsn01_body_size_and_hash", "SELECT doc_id, strlen(text) AS bytes, sha256(text) AS digest FROM documents")
def jsn01(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


@query("jsn02_event_fields", "SELECT event_id, len(json_keys(props)) AS n FROM events WHERE json_valid(props)")
def jsn02(spark, sf_dir):
    return _events(spark, sf_dir).where(F.try_parse_json("props").isNotNull()).select("event_id", F.json_object_keys("props").alias("k")).select("event_id", F.size("k").cast("long").alias("n"))


@query("qry15_server_status")
def qry15(spark, sf_dir):
    e, c = _events(spark, sf_dir), T.chunks(spark, sf_dir)
    return rollups.server_status(c, e.select(F.col("value").alias("latency_ms"), F.col("event_type").alias("kind")))
