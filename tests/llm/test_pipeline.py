"""The corpus pipeline against a plain version of each stage on what the stage before kept."""

from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from palimpsest.llm import queries

from . import brute
from ..conftest import SMALL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    frames = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, SMALL), "test-stage")
        frames.append(docs.collect())
    return frames


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_columns(stages):
    for rows in stages[1:5]:
        assert list(rows[0].asDict()) == COLUMNS


def test_quality_keeps_documents_within_the_rules(stages):
    kept = set(ids(stages[1]))
    failed = set()
    for r in stages[0]:
        n, _, _, _, repeats = brute.quality(r["text"])
        if n < 50 or 100 * repeats > 50 * n:
            failed.add(r["doc_id"])
    assert not kept & failed and len(kept) > 0.8 * (len(stages[0]) - len(failed))


def test_exact_copies(stages):
    least: dict = {}
    for r in stages[1]:
        least[r["text"]] = min(least.get(r["text"], r["doc_id"]), r["doc_id"])
    assert ids(stages[2]) == sorted(least.values())


def test_near_copies(stages):
    found = brute.near([(r["doc_id"], r["text"]) for r in stages[2]], 5)
    assert ids(stages[3]) == sorted(i for i, _, _, kept in found if kept)


def test_secrets_are_gone(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert ids(stages[4]) == sorted(before)
    for r in stages[4]:
        assert brute.secret_base(r["text"]) == "" and r["n_chars"] == len(r["text"])
        if brute.secret_base(before[r["doc_id"]]["text"]) == "" and "@" not in before[r["doc_id"]]["text"]:
            assert r["text"] == before[r["doc_id"]]["text"] or "[SECRET]" in r["text"]


def test_run_packs_what_is_left(spark, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(key, stages[5]))


def test_empty_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for rows, least in ((docs.limit(0), 0), (docs.limit(30).unionByName(docs.limit(30)), 1)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = corpus_pipeline.save(stage(spark, rows, SMALL), "test-edge")
            if k == 1:
                assert rows.count() == rows.dropDuplicates(["text"]).count()
        assert rows.count() >= least


def test_hard_rows(spark):
    """Long repetitive texts, nulls, and extra columns whose names the stages use themselves."""
    words, other, third = (" ".join(f"{w}{i} of{i % 97}" for i in range(400)) for w in ("word", "other", "third"))
    texts = [words + " x@b" + ".c" * 200_000, None, "", words, words, other + " token=abcdef123 user: bob", "a" * 300_000, ("row " * 3 + "\n") * 30_000, third + " " + "f" * 100_000]
    rows = [(i if i != 3 else None, t, "en", None, len(t or ""), "k", 7, "d") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, v int, `doc.id` string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.save(stage(spark, docs, SMALL), "test-hard")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "v", "doc.id"]
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {0, 5, 8}  # 3, of null id, and 4 repeat each other and are near copies of 0; the rest fails the rules
    assert all("token=abcdef123" not in t and "f" * 24 not in t for t in left.values())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= len(left)


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in __spark_entry__.queries()}
    assert {f"op{i}" for i in range(1, 11)} | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    from ..test_oracles import rows_of

    found = queries.QUERIES[name](spark, SMALL)
    said = duck.sql(queries.ORACLES[name])
    names = sorted(found.columns)
    assert rows_of(names, found.columns, found.collect()) == rows_of(names, said.columns, said.fetchall())
