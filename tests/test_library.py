"""Functions, readers and store beyond what the SQL comparisons reach."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from palimpsest.config import Config
from palimpsest.functions import text as tx
from palimpsest.operators import cache, chunking, search, store
from palimpsest.schema import vector_length
from palimpsest.sources import readers
from palimpsest.streaming import jobs
from palimpsest.streaming.source import AppendedLines


def test_split_covers_the_text():
    text = "".join(f"Sentence number {i}. " for i in range(2000))
    parts = tx.split_text(text)
    assert all(len(p) <= 8000 for p in parts) and text.startswith(parts[0]) and text.endswith(parts[-1])
    at = 0
    for p in parts:
        found = text.index(p, max(0, at - 1600))
        assert found <= at
        at = found + len(p)
    assert at == len(text)
    assert tx.split_text("") == [""] and tx.split_text("a" * 8000) == ["a" * 8000]


def test_split_prefers_paragraphs():
    text = "x" * 7500 + "\n\n" + "y" * 3000
    assert tx.split_text(text)[0] == "x" * 7500 + "\n\n"


def test_cleaned_text():
    assert tx.clean_for_embedding("a\u0000b ====== c") == "a b == c"
    assert tx.clean_for_embedding("k " + "Zz9+" * 20) == "k [encoded data]"
    assert tx.clean_for_embedding("  ") == ""


def test_lines_end_at_newlines_only(spark):
    rows = spark.createDataFrame([("/p", "a\r\nb\rc\n\nd\n")], "path string, content string")
    assert [(r["line"], r["text"]) for r in readers.lines(rows).orderBy("line").collect()] == [(1, "a"), (2, "b\rc"), (4, "d")]
    assert rows.select(readers.line_count(F.col("content"))).first()[0] == 4


def test_bad_utf8_fails(spark):
    rows = spark.createDataFrame([("/p", bytearray(b"\xff\xfe"))], "path string, bytes binary")
    with pytest.raises(Exception, match="not UTF-8"):
        readers.text_of(rows).collect()


def test_deep_json_is_refused(spark):
    deep = '{"type": "x", "a": ' + "[" * 60 + "]" * 60 + "}"
    flat = '{"type": "x", "a": "' + "[" * 60 + '"}'
    rows = spark.createDataFrame([("/p", 1, deep), ("/p", 2, flat)], "path string, line long, text string")
    assert [r["reason"] for r in readers.parsed(rows).orderBy("line").collect()] == ["too_deep", None]


def test_reading_files(spark, tmp_path):
    os.makedirs(tmp_path / "-proj")
    (tmp_path / "-proj" / "s.jsonl").write_text('{"type":"user","message":{"content":"q"}}\n{"type":"assistant","message":{"content":[{"type":"text","text":"a"}]}}\n')
    entries = readers.primary_entries(readers.lines(readers.text_of(readers.files(spark, str(tmp_path), "primary"))))
    pairs = chunking.paired(entries).collect()
    assert [(p["user_text"], p["assistant_text"], p["project_name"]) for p in pairs] == [("q", "a", "proj")]


def test_compact_summaries_are_transparent(spark):
    rows = [("s", 1, "user", "q", "p", None, False), ("s", 2, "user", "sum", "p", None, True), ("s", 3, "assistant", "a", "p", None, False)]
    e = spark.createDataFrame(rows, "session_id string, line long, role string, text string, project_name string, ts timestamp, is_summary boolean")
    assert [(p["user_line"], p["assistant_line"]) for p in chunking.paired(e).collect()] == [(1, 3)]


def test_file_change_ids_differ(spark):
    op = "array<struct<file_path: string, operation: string, summary: string, tool_id: string>>"
    rows = [("s", "p", "t", "u", [("f", "edit", "x", "t1"), ("f", "edit", "x", "t2"), ("f", "edit", "x", None)])]
    t = spark.createDataFrame(rows, f"session_id string, project_name string, time string, user_text string, ops {op}")
    assert chunking.file_change_chunks(t).select("id").distinct().count() == 3


def test_upsert_keeps_the_last(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    b = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, x int, seq int")
    assert sorted(map(tuple, store.upsert(t, b).collect())) == [("a", 1), ("b", 4), ("c", 5)]


def test_mixed_batches_are_refused(spark):
    with pytest.raises(ValueError):
        store.check_batch(spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, vector array<float>"))


def test_failing_texts_are_left_out():
    import pandas as pd

    def embed(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError
        return [[1.0] for _ in texts]

    run = store.embed_batches(embed, size=2, retries=0, wait=0)
    out = pd.concat(run(iter([pd.DataFrame({"id": ["a", "b", "c", "d"], "content": ["x", "bad", " ", "y"]})])))
    assert out["id"].tolist() == ["a", "d"]
    with pytest.raises(RuntimeError):
        list(run(iter([pd.DataFrame({"id": ["a"], "content": ["bad"]})])))


def test_limits_and_lookups(spark):
    with pytest.raises(ValueError):
        search.check_limit(0)
    t = spark.createDataFrame([("0123456789abcdef",)], "id string")
    assert store.by_id(t, "0123456789abcdef").count() == 1 and store.by_id(t, "x'; --").count() == 0
    assert vector_length("bge-m3:latest") == 1024 and vector_length("other") == 768 and vector_length("other", 5) == 5


def test_knn_is_one_sorted_scan(spark):
    from palimpsest.plans import tables

    from .conftest import SMALL

    near = search.vector_candidates(tables.chunks(spark, SMALL), [1.0] * 64, 5, search.Filters(project_name="src1"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [IsNotNull(source), EqualTo(source,src1)" in plan


def test_cache():
    now = [0.0]
    c = cache.Cache(2, 10, lambda: now[0])
    c.put("a", [1])
    c.get("a").append(2)
    assert c.get("a") == [1]
    c.put("b", 2)
    c.get("a")
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == [1]
    now[0] = 11
    assert c.get("a") is None and c.expire() == 1 and len(c) == 0
    assert cache.key(" Q ", None, "hybrid", 5) == cache.key("q", None, "hybrid", 5) != cache.key("q", None, "hybrid", 5, "2026")


def test_config_ignores_bad_values(monkeypatch):
    monkeypatch.setenv("PALIMPSEST_SEARCH_LIMIT", "7")
    monkeypatch.setenv("PALIMPSEST_CACHE_SECONDS", "soon")
    monkeypatch.setenv("PALIMPSEST_RRF_K", "-1")
    c = Config.from_environment()
    assert (c.search_limit, c.cache_seconds, c.rrf_k) == (7, 300.0, 60)


def test_appended_lines_are_paired_across_batches(spark, tmp_path):
    import json

    log = tmp_path / "s.jsonl"
    line = lambda role, text: json.dumps({"type": role, "sessionId": "s", "message": {"content": text}}) + "\n"
    spark.dataSource.register(AppendedLines)
    target, offsets = jobs.places(spark, "appended")

    def drain():
        lines = spark.readStream.format("appended_lines").options(path=str(tmp_path / "*.jsonl"), progress=str(tmp_path / "progress")).load()
        entries = readers.primary_entries(lines.select("path", (F.col("position") + 1).alias("line"), "text")).select("session_id", "line", "role", "text", "project_name", "ts")
        jobs.pairs_to(entries, target, offsets)
        return sorted((r["user_text"], r["assistant_text"]) for r in spark.read.parquet(target).collect())

    log.write_text(line("user", "q1") + line("assistant", "a1") + line("user", "q2"))
    assert drain() == [("q1", "a1")]
    with log.open("a") as f:
        f.write(line("assistant", "a2"))
    assert drain() == [("q1", "a1"), ("q2", "a2")]


def test_every_query_of_a_batch_is_answered(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    asked = spark.range(25_000).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, F.array(F.lit(2.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("vector"))
    found = search.search_batch(c, asked, 1)
    assert found.where(F.col("id") == F.when(F.col("qid") % 2 == 0, "a").otherwise("b")).select("qid").distinct().count() == found.count() == 25_000


def test_question_vectors_are_those_of_the_model(spark):
    from palimpsest.plans import catalog, tables

    from .conftest import SMALL

    asked = {r["qid"]: r["question"] for r in tables.questions(spark, SMALL).collect()}
    found = {r["qid"]: r["vector"] for r in catalog.QUERIES["qry13_question_vector"](spark, SMALL).collect()}
    assert set(found) == {q for q, t in asked.items() if t.strip()}
    assert all(v == pytest.approx(store.hashed_vectors(64)([asked[q]])[0], abs=1e-6) for q, v in found.items())


def test_sources_are_the_most_relevant_of_many(spark):
    from palimpsest.operators import synthesize

    many = spark.range(300).select(F.format_string("%03d", 299 - F.col("id")).alias("id"), (F.col("id") * 7 % 300 / 300.0).alias("score")).repartition(5)
    found = synthesize.sources(many).collect()
    best = sorted((r["score"], r["id"]) for r in many.collect())[:100]
    assert [(r["score"], r["id"]) for r in sorted(found, key=lambda r: r["nth"])] == best
