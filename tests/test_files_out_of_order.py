"""A stream of files whose times are in another order than their rows."""

from __future__ import annotations

import glob
import os

from palimpsest.plans import catalog


def test_the_greatest_row_wins_whatever_batch_brings_it(spark, tmp_path):
    at = f"{tmp_path}/documents.parquet"
    spark.range(0, 4000, 1, 10).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(at)
    files = sorted(glob.glob(f"{at}/*.parquet"))
    assert len(files) == 10
    for k, f in enumerate(files):
        os.utime(f, (1_700_000_000 - 864_000 * k,) * 2)
    found = {r["id"]: r["doc_id"] for r in catalog.QUERIES["stm04_snk02_streamed_upserts"](spark, str(tmp_path)).collect()}
    assert found == {n % 300: n for n in range(4000)}
    assert [tuple(r) for r in catalog.QUERIES["stm20_full_reindex"](spark, str(tmp_path)).collect()] == [(300, 300)]
