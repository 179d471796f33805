"""The table that is merged on read: what writes and merges cost, what they leave alone, and equality with a plain dictionary."""

from __future__ import annotations

import hashlib
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.operators.mergetable import MergeTable
from palimpsest.streaming import jobs


def bytes_of(path):
    """Bytes and digests of all data files below a folder."""
    found = {}
    for d, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                with open(f"{d}/{n}", "rb") as f:
                    found[os.path.relpath(f"{d}/{n}", path)] = hashlib.sha256(f.read()).hexdigest()
    return found


def rows(spark, held, seq=0):
    return spark.createDataFrame([(k, v, seq) for k, v in held.items()], "id string, v string, seq long")


def state(table):
    return {r["id"]: r["v"] for r in table.read().collect()}


def test_any_sequence_of_writes_deletes_and_merges(spark, tmp_path):
    rng, table, held = random.Random(3), MergeTable(spark, str(tmp_path / "t"), target=1 << 12), {}
    for step in range(12):
        ids = [f"{rng.randint(0, 60):03}" for _ in range(rng.choice([1, 5, 40]))]
        if step % 4 == 3:
            table.delete(spark.createDataFrame([(i,) for i in set(ids)], "id string"))
            held = {k: v for k, v in held.items() if k not in ids}
        else:
            batch = {i: f"{step}-{i}" for i in ids}
            table.upsert(rows(spark, batch))
            held |= batch
        if step % 3 == 2:
            table.merge()
        assert state(table) == held, step
    table.merge()
    table.vacuum(keep=1)
    assert state(table) == held
    assert set(bytes_of(tmp_path / "t" / "data")) == {f["file"] for f in table.version()["files"]}


def test_a_small_batch_writes_little_and_its_merge_rewrites_no_large_file(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), target=1 << 16)
    many = spark.range(40_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("v"), F.lit(0).alias("seq"))
    table.upsert(many)
    table.merge()
    whole = sum(f["bytes"] for f in table.version()["files"])
    before = bytes_of(tmp_path / "t")
    some = many.where(F.col("id").like("a00%")).withColumn("v", F.lit("new"))
    n = some.count()
    table.upsert(some)
    delta = [f for f in table.version()["files"] if f["delta"]]
    assert 0 < n < 40 and sum(f["bytes"] for f in delta) < 0.02 * whole
    assert before.items() <= bytes_of(tmp_path / "t").items()  # nothing was written anew
    done = table.merge()
    assert done.rewritten_bytes < 0.3 * whole and done.written_bytes < 0.3 * whole and done.kept_files > 0
    after = bytes_of(tmp_path / "t")
    assert all(after[f"data/{f['file']}"] == before.get(f"data/{f['file']}", after[f"data/{f['file']}"]) for f in table.version()["files"])
    assert table.read().where("v = 'new'").count() == n and table.read().count() == 40_000


def test_dead_rows_beside_a_kept_file(spark, tmp_path, monkeypatch):
    """A file that loses a few rows stays as it is; once a fifth is dead it is rewritten."""
    monkeypatch.setattr("palimpsest.operators.mergetable.SMALL", 0)
    table = MergeTable(spark, str(tmp_path / "t"))
    table.upsert(rows(spark, {f"{i:03}": "a" for i in range(100)}))
    table.merge()
    first = {f["file"] for f in table.version()["files"]}
    table.upsert(rows(spark, {"050": "b"}))
    table.merge()
    assert len(first) == 1 and first < {f["file"] for f in table.version()["files"]}
    assert sum(f["dead"] for f in table.version()["files"]) == 1 and state(table) == {f"{i:03}": "b" if i == 50 else "a" for i in range(100)}
    table.upsert(rows(spark, {f"{i:03}": "c" for i in range(0, 100, 2)}))
    table.merge()
    assert not first & {f["file"] for f in table.version()["files"]} and sum(f["dead"] for f in table.version()["files"]) == 0
    assert state(table) == {f"{i:03}": "c" if i % 2 == 0 else "a" for i in range(100)}


def test_only_files_whose_keys_meet_the_delta_are_compared(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), target=1 << 14)
    table.upsert(rows(spark, {f"{i:06}": "x" * 50 for i in range(20_000)}))
    table.merge()
    table.upsert(rows(spark, {"000005": "y"}))
    far, met, _ = table._split(table.version())
    assert len(met) == 1 and len(far) > 3 and state(table)["000005"] == "y"


def test_order_by_a_column_of_the_table(spark, tmp_path):
    """A late smaller value loses, in a delta and after a merge."""
    table = MergeTable(spark, str(tmp_path / "t"), ("file",), ("position",))
    put = lambda *r: table.upsert(spark.createDataFrame(list(r), "file string, position long"))
    put(("a", 5), ("a", 7), ("b", 1))
    put(("a", 6), ("b", 2))
    assert {tuple(r) for r in table.read().collect()} == {("a", 7), ("b", 2)}
    table.merge()
    put(("a", 1))
    assert {tuple(r) for r in table.read().collect()} == {("a", 7), ("b", 2)}
    table.merge()
    assert {tuple(r) for r in table.read().collect()} == {("a", 7), ("b", 2)}


def test_a_batch_sent_again_and_two_writers(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"))
    assert table.upsert(rows(spark, {"a": "1"}), number=0) and table.upsert(rows(spark, {"a": "2"}), number=1)
    assert not table.upsert(rows(spark, {"a": "1"}), number=0) and state(table) == {"a": "2"}
    seen = table.version()
    table.upsert(rows(spark, {"b": "1"}), number=2)
    with pytest.raises(Exception, match="exists"):
        table._commit(seen, files=[])  # a writer that still sees the version before
    assert state(table) == {"a": "2", "b": "1"}
    assert {r["id"] for r in table.read(0).collect()} == {"a"}


def test_clustering_lets_filters_skip_row_groups(spark, tmp_path):
    table = MergeTable(spark, str(tmp_path / "t"), cluster=("project", "at"), target=1 << 15)
    n = F.col("id")
    c = spark.range(30_000).select(F.sha2(n.cast("string"), 256).alias("id"), F.concat(F.lit("p"), F.format_string("%02d", n * 7919 % 40)).alias("project"), (n * 104729 % 30_000).alias("at"), F.lit(0).alias("seq"))
    table.upsert(c)
    table.merge()
    files = [pq.ParquetFile(f"{tmp_path}/t/data/{f['file']}") for f in table.version()["files"]]
    at = {m.schema_arrow.names[i]: i for m in files[:1] for i in range(len(m.schema_arrow.names))}

    def touched(test):
        groups = [f.metadata.row_group(g) for f in files for g in range(f.metadata.num_row_groups)]
        return sum(test({c: g.column(i).statistics for c, i in at.items()}) for g in groups) / len(groups)

    assert touched(lambda s: s["project"].min <= "p07" <= s["project"].max) < 0.4
    assert touched(lambda s: s["at"].min <= 12_000 and 10_000 <= s["at"].max) < 0.4
    assert table.read().where("project = 'p07'").count() == c.where("project = 'p07'").count()


def test_a_stream_of_small_batches_is_merged_in_the_background(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("palimpsest.operators.mergetable.DELTAS", 3)
    inbox, target, offsets = (str(tmp_path / n) for n in ("in", "t", "o"))
    held = {}
    for k in range(6):
        batch = {f"{i:03}": f"{k}" for i in range(k * 10, k * 10 + 25)}
        held |= batch
        rows(spark, batch, k).coalesce(1).write.mode("append").parquet(inbox)
        jobs.upsert_to(spark.readStream.schema("id string, v string, seq long").parquet(inbox), target, offsets)
    assert {r["id"]: r["v"] for r in jobs.latest_version(spark, target).collect()} == held
    table = MergeTable(spark, target)
    assert len(table.versions()) <= 4 and len({f["file"].split("/")[0] for f in table.version()["files"] if f["delta"]}) <= 3
