"""What stages shuffle, and where results are looked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.operators.mergetable import MergeTable
from palimpsest.operators.textindex import TextIndex
from palimpsest.plans import tables

from .conftest import SMALL


def shuffled(spark, run) -> tuple[int, int]:
    """Rows and bytes that the stages of ``run`` write to shuffles."""
    context = spark.sparkContext
    gateway, jvm = context._gateway, context._jvm

    def told() -> tuple[int, int]:
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        each = [stages.apply(i) for i in range(stages.size())]
        return sum(s.shuffleWriteRecords() for s in each), sum(s.shuffleWriteBytes() for s in each)

    before = told()
    run()
    return tuple(a - b for a, b in zip(told(), before, strict=True))


def test_an_index_deals_texts_and_posting_rows_only(spark, tmp_path):
    """One row a chunk and one a token of a block, not one a use of a token."""
    texts = spark.range(1500).selectExpr("cast(id AS string) AS id", "concat_ws(' ', transform(sequence(1, 60), k -> concat('w', (id * 7 + k) % 97))) AS content").coalesce(2)
    index = TextIndex(spark, str(tmp_path))
    rows, _ = shuffled(spark, lambda: index.build(texts))
    assert index.postings().count() == 1500 * 60
    assert rows < 1500 * 60 / 10


def test_results_are_found_before_texts_are_joined(spark):
    """The ids of a short list reach the scan of the documents."""
    wide = search.hybrid_search(tables.chunks(spark, SMALL), "the queion therand", [1.0] * 64, 5, index=tables.text_index(spark, SMALL))
    plan = wide._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = next(k for k, line in enumerate(plan) if "LeftOuter" in line)
    assert any("sha2" in line and "Filter" in line and " IN " in line.upper() for line in plan[joined + 1 :])
    assert wide.count() == 5


def test_writes_and_reads_of_a_table_shuffle_keys_only(spark, tmp_path):
    """Rows of 2 KB that don't compress, a third of them changed, some of them twice in a batch."""
    rows = spark.range(3000).selectExpr("cast(id AS string) AS id", "id AS n", "concat_ws('', transform(sequence(1, 32), k -> sha2(concat(id, '-', k), 256))) AS content").coalesce(2)
    changed = rows.where("n % 3 = 0")
    batch = changed.selectExpr("*", "1 AS seq").unionByName(changed.where("n % 2 = 0").selectExpr("id", "n + 100000 AS n", "content", "2 AS seq"))
    held = MergeTable(spark, str(tmp_path))
    table = lambda: {r["id"]: r["n"] for r in held.read().select("id", "n", F.md5("content")).collect()}
    _, moved = shuffled(spark, lambda: (held.upsert(rows.withColumn("seq", F.lit(0))), held.upsert(batch), table()))
    assert table() == {str(i): i + 100000 if i % 6 == 0 else i for i in range(3000)}
    assert moved < 3000 * 2048 / 4
    held.delete(rows.where("n % 5 = 1").select("id"))
    held.merge()
    assert table() == {str(i): i + 100000 if i % 6 == 0 else i for i in range(3000) if i % 5 != 1}
