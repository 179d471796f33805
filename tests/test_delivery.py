"""Packing, interval expansion, ordered delivery and atomic uploads against plain versions and broken runs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chunking, delivery, store
from palimpsest.operators.mergetable import MergeTable
from palimpsest.operators.ordered import running
from palimpsest.plans import tables
from palimpsest.streaming import delivery as jobs

from .conftest import SMALL


def plain_records(chunks, most_rows, most_bytes):
    """(file, line, record, rows, bytes, start, position, final, oversize) by a loop over each file."""
    out, by = [], {}
    for f, line, seq, size in sorted(chunks):
        by.setdefault((f, line), []).append(size)
    before: dict = {}
    for (f, line), sizes in sorted(by.items()):
        records = [[sizes[0]]]
        for size in sizes[1:]:
            if len(records[-1]) == most_rows or sum(records[-1]) + size > most_bytes:
                records.append([])
            records[-1].append(size)
        start = before.get(f, 0)
        for k, r in enumerate(records):
            final = k == len(records) - 1
            out.append((f, line, k, len(r), sum(r), start, line if final else start, final, sum(r) > most_bytes))
        before[f] = line
    return sorted(out)


@pytest.mark.parametrize("seed,lines,each", [(1, 60, 9), (2, 2, 900), (3, 300, 1)])
def test_records_are_those_of_a_loop(spark, seed, lines, each):
    rng = random.Random(seed)
    chunks = [(f"f{rng.randint(0, 1)}", line, seq, rng.choice([0, 5, 40, 90, 400])) for line in range(1, lines + 1) for seq in range(rng.randint(1, each))]
    d = spark.createDataFrame(chunks, "source_file string, line long, seq long, bytes long")
    assert sorted(tuple(r) for r in chunking.packed_uploads(d, 7, 300).collect()) == plain_records(chunks, 7, 300)


def test_one_hot_file_is_spread_over_tasks(spark):
    """A file with 200 000 lines: no task gets more than its share of the running sums."""
    lines = spark.range(200_000).select(F.lit("hot").alias("source_file"), F.col("id").alias("line"))
    found = running(lines, ["source_file"], [F.col("line")], {"n": ("count", F.lit(1)), "before": ("max", F.col("line"))})
    assert found.where("n <> line + 1 OR before <> line").isEmpty()
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * 200_000


def test_consecutive_intervals_hand_on_every_pair_once(spark):
    entries = tables.entries(spark, SMALL).cache()
    pairs = sorted((r["session_id"], r["user_line"], r["assistant_line"]) for r in chunking.paired(entries).select("session_id", "user_line", "assistant_line").collect())
    last = {r["session_id"]: r["n"] for r in entries.groupBy("session_id").agg(F.max("line").alias("n")).collect()}
    rng, at, seen = random.Random(4), dict.fromkeys(last, 0), []
    for step in range(5):
        wanted = [(s, at[s], n if step == 4 else rng.randint(at[s], n)) for s, n in last.items()]
        intervals = spark.createDataFrame(wanted, "session_id string, start_exclusive long, end_inclusive long")
        seen += [(r["file"], r["user_line"], r["line"]) for r in delivery.expanded(entries, intervals).collect()]
        for r in chunking.safe_interval(entries, intervals).collect():
            at[r["session_id"]] = max(at[r["session_id"]], r["safe_end"])
    assert sorted(seen) == pairs
    entries.unpersist()


def test_intervals_that_go_back_are_errors(spark):
    entries = spark.createDataFrame([("a", 1, "user", "q", "p", None), ("a", 2, "assistant", "r", "p", None), ("a", 3, "user", "s", "p", None)], "session_id string, line long, role string, text string, project_name string, ts timestamp")
    wanted = spark.createDataFrame([("a", 0, 3), ("b", 3, 1)], "session_id string, start_exclusive long, end_inclusive long")
    assert {tuple(r) for r in delivery.expanded(entries, wanted).collect()} == {("a", 1, 2, 2, None), ("b", None, None, None, "regressive boundary")}


def test_an_outage_between_two_runs_changes_nothing(spark, tmp_path):
    def sender(down):
        return lambda file, seq, tries: "down" if down and seq > 3 else "blocked" if seq == 5 and tries < 3 or (file, seq) == ("b", 6) else "ok"

    def run(name, parts):
        inbox, target, offsets = (f"{tmp_path}/{name}-{x}" for x in ("in", "out", "at"))
        for rows, down in parts:
            spark.createDataFrame(rows, "file string, seq long").coalesce(1).write.mode("append").parquet(inbox)
            jobs.deliver_to(spark.readStream.schema("file string, seq long").parquet(inbox), target, offsets, sender(down), partitions=2)
        return sorted(tuple(r) for r in spark.read.schema("file string, seq long, tries int").parquet(target).collect())

    rows = [(f, s) for f in "abc" for s in range(1, 9)]
    whole = run("one", [(rows, False)])
    assert whole == sorted((f, s, 3 if s == 5 else 1) for f, s in rows if f != "b" or s < 6)
    again = [r for r in rows if r[1] <= 4]  # sent a second time with what follows
    assert run("two", [(again, True), (rows, False)]) == whole


def test_a_batch_that_dies_leaves_all_or_nothing(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "store")
    rows = [(1, "f", 10, 2, "a", "text a"), (1, "f", 10, 2, "b", "text b"), (2, "f", 20, 2, "c", "bad"), (2, "f", 20, 2, "d", "text d"), (3, "g", 5, 2, "e", "one of two")]
    batch = spark.createDataFrame(rows, "upload long, file string, end long, n long, id string, content string")

    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return store.hashed_vectors(4)(texts)

    chunks, cursors = jobs.upload_tables(spark, target)
    commit = MergeTable._commit

    def die(self, before, **changes):
        raise RuntimeError("lost")

    monkeypatch.setattr(MergeTable, "_commit", die)
    with pytest.raises(RuntimeError):
        jobs.store_uploads(batch, target, embed, 0)
    for table in (chunks, cursors):
        with pytest.raises(FileNotFoundError):
            table.read()
    monkeypatch.setattr(MergeTable, "_commit", commit)
    assert jobs.store_uploads(batch, target, embed, 0) and not jobs.store_uploads(batch, target, embed, 0)
    assert {r["id"] for r in chunks.read().collect()} == {"a", "b"} and [tuple(r) for r in cursors.read().collect()] == [("f", 10)]
    assert len(chunks.versions()) == 1  # chunks and positions came with one version
    whole = spark.createDataFrame([(2, "f", 20, 1, "c", "good"), (4, "f", 8, 1, "z", "late")], batch.schema)
    jobs.store_uploads(whole, target, embed, 1)
    assert {r["id"] for r in chunks.read().collect()} == {"a", "b", "c", "z"} and [tuple(r) for r in cursors.read().collect()] == [("f", 20)]
    for table in (chunks, cursors):
        table.merge()
    chunks.vacuum(keep=1)
    assert chunks.read().count() == 4 and [tuple(r) for r in cursors.read().collect()] == [("f", 20)]
