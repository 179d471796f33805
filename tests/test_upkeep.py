"""Upkeep, delivery, providers, limits and the sources' rules on small fixtures."""

from __future__ import annotations

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import delivery, limits, maintenance, providers, store, stores, synthesize
from palimpsest.operators import search, textindex
from palimpsest.operators.mergetable import MergeTable
from palimpsest.operators.textindex import TextIndex
from palimpsest.plans import catalog, tables
from palimpsest.streaming import jobs
from palimpsest.streaming import source as appended
from palimpsest.streaming.cursors import CursorFile

from .conftest import SMALL


def test_a_blocked_file_blocks_only_itself(spark):
    rows = [("a", 1, "ok"), ("a", 2, "blocked"), ("a", 3, "ok"), ("b", 2, "ok"), ("b", 5, "ok"), ("c", 4, "down"), ("b", 3, "ok")]
    found = {(r["file"], r["seq"]) for r in delivery.delivered(spark.createDataFrame(rows, "file string, seq long, outcome string")).where("delivered").collect()}
    assert found == {("a", 1), ("b", 2), ("b", 3)}


def test_acknowledgement_is_all_or_nothing(spark):
    up = spark.createDataFrame([("a", 5, 3, 3, 3, 3), ("a", 9, 4, 4, 3, 4), ("b", 2, 1, 1, 1, 1)], "file string, end long, n long, received long, embedded long, stored long")
    now = spark.createDataFrame([("a", 1), ("b", 7), ("c", 0)], "file string, position long")
    assert {tuple(r) for r in delivery.advanced(now, delivery.acknowledged(up)).collect()} == {("a", 5), ("b", 7), ("c", 0)}


def test_cursor_state_survives_a_failed_save(spark, tmp_path):
    state = CursorFile(spark, str(tmp_path / "state"))
    assert state.load() == {}
    state.save({"a": 3})
    with pytest.raises(TypeError):
        state.save({"a": object()})
    assert CursorFile(spark, str(tmp_path / "state")).load() == {"a": 3}
    assert state.advance({"a": 1, "b": 2}) == {"a": 3, "b": 2}
    assert len([f for f in os.listdir(tmp_path / "state") if f.startswith("state-")]) <= 2


def test_providers_check_their_answers():
    good = providers.IndexedProvider(lambda texts: [(1, [2.0]), (0, [1.0])], 1)
    assert good(["a", "b"]) == [[1.0], [2.0]]
    for answer in ([(0, [1.0])], [(0, [1.0]), (2, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            providers.IndexedProvider(lambda texts, a=answer: a, 1)(["a", "b"])
    calls = []
    one = providers.SingleProvider(lambda t, task: calls.append((t, task)) or [0.0], 1, "query")
    one(["a", "b"])
    assert calls == [("a", "query"), ("b", "query")]


def test_request_bounds(spark):
    rows = spark.createDataFrame([("q" * 513, 1), ("q", 0), ("q", 100), (" ", 5), ("q" * 600, 51)], "q string, n int")
    told = rows.select(limits.request_error(F.col("q"), F.col("n"), "http").alias("a"), limits.request_error(F.col("q"), F.col("n"), "tool").alias("b")).collect()
    assert [tuple(r) for r in told] == [("question too long", None), ("limit out of range", "limit out of range"), (None, "limit out of range"), ("empty question", "empty question"), ("question too long", "limit out of range")]


def test_stores(spark, tmp_path):
    c = tables.chunks(spark, SMALL)
    held = stores.open_store(spark, "scratch")
    held.append(c)
    found = held.text_search("the queion", 5)
    assert [r["id"] for r in found.orderBy("score", "id").collect()] == [r["id"] for r in search.text_search(c, "the queion", 5).orderBy("score", "id").collect()]
    assert held.clear() == c.count() and held.table().count() == 0
    held.close()
    with pytest.raises(ValueError):
        stores.open_store(spark, "nowhere")


FILTERS = (search.Filters(), search.Filters(project_name="src3"), search.Filters(chunk_type="turn", date_from="2026-01-01 00:30:00"))


@pytest.mark.parametrize("direct", [0, 10**9])
def test_index_agrees_with_a_scan(spark, tmp_path, direct, monkeypatch):
    """Over one segment and over many, by blocks and at once."""
    monkeypatch.setattr(textindex, "FIRST", 2)
    c = tables.chunks(spark, SMALL)
    rows = lambda d: [tuple(r) for r in d.orderBy(F.desc("relevance"), "id").collect()]
    index = TextIndex(spark, str(tmp_path / "one"), block=4, direct=direct).build(c)
    for question in ("the queion therand", "und", "absentword", "the und der die"):
        for filters in FILTERS[: 3 if direct else 1]:
            assert rows(search.text_candidates(c, question, 12, filters, index)) == rows(search.text_candidates(c, question, 12, filters))


def test_changed_and_removed_chunks(spark, tmp_path):
    c = tables.chunks(spark, SMALL)
    rows = lambda d: [tuple(r) for r in d.orderBy(F.desc("relevance"), "id").collect()]
    index = TextIndex(spark, str(tmp_path / "index"), block=4, direct=0).build(c.where("doc_id < 100"))
    before = {n for n in os.listdir(tmp_path / "index") if n != "log"}
    changed = c.where("doc_id >= 90").withColumn("content", F.when(F.col("doc_id") < 110, F.concat(F.lit("the queion anew "), "content")).otherwise(F.col("content")))
    index.add(changed)
    assert before < {n for n in os.listdir(tmp_path / "index") if n != "log"}  # an added batch leaves what is there alone
    index.remove(c.where("doc_id % 10 = 3").select("id"))
    now = c.where("doc_id < 90").unionByName(changed).where("doc_id % 10 <> 3")
    for question in ("the queion therand anew", "und der"):
        for filters in FILTERS:
            assert rows(search.text_candidates(c, question, 15, filters, index)) == rows(search.text_candidates(now, question, 15, filters))
    for lo in range(0, 200, 50):
        index.add(now.where((F.col("doc_id") >= lo) & (F.col("doc_id") < lo + 50)))
    assert len(index.segments()) < 6 and sum(s["docs"] for s in index.segments()) >= now.count()  # segments of a size were merged
    assert rows(search.text_candidates(c, "the queion anew", 15, index=index)) == rows(search.text_candidates(now, "the queion anew", 15))
    index.vacuum(keep=1)
    assert {n for n in os.listdir(tmp_path / "index") if n != "log"} == {s["name"] for s in index.segments()}
    assert index.lengths().count() == now.count()


def test_blocks_that_cannot_reach_the_best_are_not_scored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "FIRST", 4)
    texts = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 400 == 0, "needle needle needle hay").otherwise(F.concat(F.lit("needle "), F.repeat(F.lit("hay "), (F.col("id") % 90 + 5).cast("int")))).alias("content"))
    index = TextIndex(spark, str(tmp_path / "index"), block=16, direct=0).build(texts)
    held = index.segments()
    docs, mean, df, _ = index._statistics(["needle"], held)
    found, scored, blocks = index._by_blocks({"needle": math.log(1 + (docs - df["needle"] + 0.5) / (df["needle"] + 0.5))}, mean, held, 5)
    assert {r["id"] for r in found.collect()} == {"0", "400", "800", "1200", "1600"} and scored < 0.2 * blocks


def test_an_index_is_built_again_when_its_table_changes(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    spark.read.parquet(f"{SMALL}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs.limit(20).write.parquet(f"{tmp_path}/documents.parquet")
    first = tables.text_index(spark, str(tmp_path))
    assert tables.text_index(spark, str(tmp_path)) is first and first.lengths().count() == 20
    docs.limit(30).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert tables.text_index(spark, str(tmp_path)).lengths().count() == 30


def test_a_failed_index_does_not_stop_compaction(spark, tmp_path):
    c = tables.chunks(spark, SMALL).drop("content")
    held = MergeTable(spark, f"{tmp_path}/t")
    held.upsert(c)
    with pytest.raises(Exception, match="content"):
        maintenance.optimise(held, f"{tmp_path}/indexes")
    assert held.read().count() == c.count() and not any(f["delta"] for f in held.version()["files"])


def _trigger(r, at):
    """One trigger as Spark runs it: the offset, and every row of its parts."""
    to = r.latestOffset()
    rows = [row[1:] for p in r.partitions(at, to) for row in r.read(p)]
    r.commit(to)
    return to, rows


def test_appended_lines_are_bounded_and_seek(tmp_path, monkeypatch):
    logs, options = tmp_path / "logs", {"path": str(tmp_path / "logs" / "**" / "*.log"), "progress": str(tmp_path / "progress")}
    path = logs / "deep" / "a.log"
    path.parent.mkdir(parents=True)
    text = b"".join(b"line %d\n" % i for i in range(1, 11)) + "\u00e4\r\n\n".encode()
    begins = [0, *[i + 1 for i, c in enumerate(text) if c == 10]][:-1]
    path.write_bytes(text + b"unfinished")
    expected = [(b, t.rstrip("\r"), 0) for b, t in zip(begins, text.decode().split("\n")[:-1], strict=True)]
    for block, most, part in ((1 << 20, 1 << 20, 1 << 20), (3, 10, 4), (1, 1, 1), (5, 17, 6)):
        monkeypatch.setattr(appended, "BLOCK", block)
        folder = options | {"progress": str(tmp_path / f"p{most}"), "maxBytesPerTrigger": str(most), "partBytes": str(part)}
        at, seen, sizes = appended._Reader(folder).initialOffset(), [], []
        while True:
            to, rows = _trigger(appended._Reader(folder), at)  # every trigger by a new reader, as after a restart
            if to == at:
                break
            before = json.loads(at["files"]).get(str(path), {"bytes": 0})["bytes"]
            sizes.append(json.loads(to["files"])[str(path)]["bytes"] - before)
            seen, at = seen + rows, to
        assert seen == expected and max(sizes) <= most and sum(sizes) == len(text) + 10

    r = appended._Reader(options)
    at, rows = _trigger(r, r.initialOffset())
    assert rows == expected
    with path.open("ab") as f:
        f.write(b" no more\nnext")
    at, rows = _trigger(r, at)
    assert rows == [(len(text), "unfinished no more", 0)]
    path.write_bytes(b"other\nlines\n")  # shorter
    at, rows = _trigger(r, at)
    assert rows == [(0, "other", 1), (6, "lines", 1)]
    path.write_bytes(b"another file, longer\nthan before\n")  # longer: its reader sees that the bytes before are others
    at, rows = _trigger(r, at)
    assert rows == []
    at, rows = _trigger(appended._Reader(options), at)
    assert rows == [(0, "another file, longer", 2), (21, "than before", 2)]
    assert _trigger(r, at) == (at, [])
    marks = sorted(p.name.split("-", 2)[2] for p in (tmp_path / "progress").glob("mark-*"))
    assert marks == [f"2-{path.stat().st_size}"] and not list((tmp_path / "progress").glob("replaced-*"))


def test_new_files_go_first_and_files_are_bounded(tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.log").write_text(f"{n}\n")
    r = appended._Reader({"path": str(tmp_path / "?.log"), "progress": str(tmp_path / "progress"), "maxFilesPerTrigger": "1"})
    at, first = _trigger(r, r.initialOffset())
    (tmp_path / "a.log").open("a").write("more\n")
    at, second = _trigger(r, at)
    at, third = _trigger(r, at)
    at, fourth = _trigger(r, at)
    assert [t for _, t, _ in first + second + third + fourth] == ["a", "b", "c", "more"]


def test_admitted_bytes_whose_offset_was_never_logged_are_read(tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    r = appended._Reader({"path": str(tmp_path / "*.log"), "progress": str(tmp_path / "progress"), "maxBytesPerTrigger": "4"})
    start = r.initialOffset()
    r.latestOffset()  # the query dies before Spark logs it
    _, rows = _trigger(r, start)
    assert [t for _, t, _ in rows] == ["one", "two"]


def test_drained_runs_until_nothing_is_left(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(50)))
    spark.dataSource.register(appended.AppendedLines)
    lines = spark.readStream.format("appended_lines").options(path=f"file://{tmp_path}/*.log", progress=f"{tmp_path}/progress", maxBytesPerTrigger="150", partBytes="40").load()
    target, offsets = jobs.places(spark, "drained")
    assert jobs.drained(lines.writeStream.format("parquet").option("path", target), offsets) >= 3
    assert sorted(r["text"] for r in spark.read.parquet(target).collect()) == sorted(f"line {i}" for i in range(50))


def test_key_points_and_look_back(spark):
    texts = ["You should restart the server because it hangs. Tiny.", "You should restart the server because it hangs!", "It is important to note the port number here. Nothing else matters today at all."]
    rows = [(0, f"i{k}", t, 0.1 * k, "turn", "s", None, None, [], []) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "qid int, id string, content string, score double, chunk_type string, session_id string, file_path string, operation string, techs array<string>, terms array<string>")
    r = synthesize.synthesized(d).first()
    assert r["key_points"].split("\n") == ["You should restart the server because it hangs", "It is important to note the port number here", "Nothing else matters today at all"]
    assert r["n_unique"] == 2 and r["deduplication_count"] == 1 and r["primary_content"].startswith("**Key Points:**\n1. You should")


def test_every_survey_group_is_registered():
    names = set(catalog.QUERIES)
    for wanted in ("snk09", "snk11", "snk12", "snk13", "snk17", "stm07", "stm09", "stm10", "stm15", "stm20", "src10", "src11", "src14", "dat07", "prj21", "syn03", "syn04", "win12", "top06", "top11", "flt20", "udf01"):
        assert any(n.startswith(wanted) for n in names), wanted
    assert store.hashed_vectors(4)(["a"])
