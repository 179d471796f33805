"""The merge index takes batches, leaves runs alone that no compaction touches, and looks up by filters."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from palimpsest.llm.exact_dedup import MergeIndex


def batch(spark, rows):
    df = spark.createDataFrame(rows, "id long, word string").repartition(3)
    return df.select(F.monotonically_increasing_id().alias("rid"), "id", F.unhex(F.sha2("word", 256)).alias("key"), "word")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-") and "manifest" not in d}


def test_batches(spark, tmp_path):
    random.seed(4)
    path, rows, levels = str(tmp_path / "index"), [], []
    for n in range(7):
        fresh = [(n * 100 + i, f"w{random.randint(0, 220)}") for i in range(60)]
        rows += fresh
        before = files(path)
        index = MergeIndex(spark, path, "smallest", memtable_rows=1000, fanout=3)  # taken up from the manifest every time
        index.add(batch(spark, fresh).drop("word"))
        after = files(path)
        levels.append(sorted(r.level for r in index.runs))
        kept = {f for r in index.runs for f in after if f.startswith((r.path + "/", r.filter + "/"))}
        assert kept == set(after)  # nothing is left of merged runs
        assert all(after[f] == t for f, t in before.items() if f in after)  # and no other run is written again
        if n % 3 != 2:
            assert set(before) <= set(after)
        by: dict = {}
        for i, w in rows:
            by.setdefault(w, []).append(i)
        found = {(r["keep"]["id"], r["n"]) for r in MergeIndex(spark, path, "smallest").repeated().collect()}
        assert found == {(min(v), len(v)) for v in by.values() if len(v) > 1}
    assert levels == [[0], [0, 0], [1], [0, 1], [0, 0, 1], [1, 1], [0, 1, 1]]


def test_many_memtables(spark):
    rows = [(i, f"w{i % 700}") for i in range(2000)]
    index = MergeIndex(spark, None, "largest", memtable_rows=100, memtables=64, fanout=2)
    index.add(batch(spark, rows).repartition(16).select(F.monotonically_increasing_id().alias("rid"), "id", "key"))
    assert {(r["keep"]["id"], r["n"]) for r in index.repeated().collect()} == {(max(range(k, 2000, 700)), len(range(k, 2000, 700))) for k in range(700)}
    index.drop()


def test_empty_index(spark):
    index = MergeIndex(spark)
    index.add(batch(spark, [(1, "x")]).where("false"))
    assert index.repeated() is None
