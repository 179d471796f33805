"""What an index moves and writes as its chunks grow."""

from __future__ import annotations

import os

from palimpsest.operators import textindex
from palimpsest.operators.textindex import TextIndex

from .test_growth import shuffled


def test_posting_rows_are_written_where_they_are_made(spark, tmp_path, monkeypatch):
    """Only texts are dealt; a file holds whole document blocks, in order of token."""
    monkeypatch.setattr(textindex, "WORDS_A_TASK", 10_000)
    texts = spark.range(1500).selectExpr("cast(id AS string) AS id", "concat_ws(' ', transform(sequence(1, 60), k -> concat('w', id * 60 + k))) AS content").coalesce(2)
    index = TextIndex(spark, str(tmp_path), block=16)
    rows, _ = shuffled(spark, lambda: index.build(texts))
    assert rows < 1500 * 2  # each of the 90 000 words is in one chunk, so there are as many posting rows
    made = spark.read.parquet(f"{tmp_path}/{index.segments()[0]['name']}/postings")
    assert made.count() == 1500 * 60 and "bucket" not in made.columns
    files = made.selectExpr("_metadata.file_path AS file", "block").distinct()
    assert files.count() == made.select("block").distinct().count() and files.select("file").distinct().count() > 4
    at = f"{tmp_path}/{index.segments()[0]['name']}/postings"
    for name in [n for n in os.listdir(at) if n.endswith(".parquet")]:
        tokens = [r[0] for r in spark.read.parquet(f"{at}/{name}").select("token").collect()]
        assert tokens == sorted(tokens)
    assert [tuple(r) for r in index.postings(["w61", "w60"]).orderBy("token").collect()] == [("w60", "0", 1, 60), ("w61", "1", 1, 60)]
