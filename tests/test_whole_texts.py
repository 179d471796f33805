"""Queries over whole texts, held against their SQL and against plain Python."""

from __future__ import annotations

import re

import pytest

from palimpsest.plans import catalog

from .conftest import SMALL
from .test_oracles import rows_of


def agrees(spark, duck, name):
    """The query says what its SQL says, and the SQL cuts no text and drops no row."""
    sql = catalog.ORACLES[name]
    assert not re.search(r"substr\((text|content), 1,|doc_id % 3 = 0|length\(text\) > 8000|length\(content\) <= 8000", sql)
    found, said = catalog.QUERIES[name](spark, SMALL), duck.sql(sql)
    names = sorted(found.columns)
    assert names == sorted(said.columns)
    assert rows_of(names, found.columns, found.collect()) == rows_of(names, said.columns, said.fetchall())


@pytest.mark.parametrize("name", ["snk16_inverted_index", "set02_distinct_terms", "str31_cache_keys", "str34_reason_texts", "arr03_rows_of_structs", "str01_split_content", "prj22_str03_win05_parts", "str04_turn_chunks"])
def test_whole_texts_of_all_rows(spark, duck, name):
    agrees(spark, duck, name)


def documents(spark, path, texts):
    """A folder whose documents are the given texts, numbered from 0."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'src' AS source", "cast(length(text) AS bigint) AS n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_reasons_behind_long_runs(spark, tmp_path):
    folder = documents(spark, tmp_path, ["*" * 500 + "late", "\x01" * 500 + "late"])
    assert [tuple(r) for r in catalog.QUERIES["str34_reason_texts"](spark, folder).orderBy("doc_id").collect()] == [(0, "late", "*" * 256), (1, "late", "late")]


def test_similarity_of_whole_texts(spark, tmp_path):
    import difflib

    texts = ["same start " * 30 + "then one end", "same start " * 30 + "and quite another finish", "short", "same start " * 40]
    found = catalog.QUERIES["str19_similarity"](spark, documents(spark, tmp_path, texts)).orderBy("doc_id").collect()
    plain = [" ".join(t.split()) for t in texts]
    assert [(r["doc_id"], r["ratio"]) for r in found] == [(i, round(difflib.SequenceMatcher(None, plain[i], plain[i + 1]).ratio(), 9)) for i in range(3)]


def test_similar_results_are_those_of_a_search(spark, tmp_path):
    folder = documents(spark, tmp_path, ["nothing of it"] * 100 + [f"the queion {i} " + chr(97 + i % 26) * (20 + i) for i in range(30)])
    spark.createDataFrame([(7, [1.0, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    found = catalog.QUERIES["syn02_similar_results"](spark, folder).first()
    assert found["n_unique"] + found["deduplication_count"] == 31 and found["n_unique"] > 20


def test_all_parts_of_long_turns(spark, tmp_path):
    from palimpsest.functions import text as tx

    answer = "".join(f"Sentence number {i}. " for i in range(1500))
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", answer), (1, 2, "user", "r"), (1, 3, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = catalog.QUERIES["str04_turn_chunks"](spark, str(tmp_path)).collect()
    parts = tx.split_text(f"In project p1, user asked:\nq\n\nAssistant responded:\n{answer.strip()}")
    assert len(parts) > 3 and sorted(r["user_line"] for r in found) == [1] * len(parts) + [3]
    import hashlib

    assert {r["content_sha"] for r in found if r["user_line"] == 1} == {hashlib.sha256(f"[Part {i}/{len(parts)}] {p}".encode()).hexdigest() for i, p in enumerate(parts, 1)}
