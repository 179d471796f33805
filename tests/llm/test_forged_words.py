"""Words made to share the hash of others, had it no key, are neither removed nor linked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import arrays, minhash, substring


def forged(n: int) -> list[tuple[str, str]]:
    """Pairs of different words of 16 printable letters whose hashes under key 0 are the same."""
    rng, pairs = np.random.default_rng(1), []
    while len(pairs) < n:
        first = rng.integers(0x21, 0x7F, (2, 50_000, 8), dtype=np.uint8)
        a, b = (arrays.mix(x.view("<u8").ravel().copy()) * arrays._MIX2 for x in first)
        tail = rng.integers(0x21, 0x7F, (50_000, 8), dtype=np.uint8)
        other = (tail.view("<u8").ravel() ^ a ^ b).view(np.uint8).reshape(-1, 8)
        for i in np.flatnonzero(((other > 0x20) & (other < 0x7F)).all(1)):
            pairs.append((bytes([*first[0, i], *tail[i]]).decode(), bytes([*first[1, i], *other[i]]).decode()))
    return pairs[:n]


def test_forged_words(spark):
    pairs = forged(14)
    one, two = (" ".join(p[k] for p in pairs) for k in (0, 1))
    assert one != two and np.array_equal(arrays.Words([one.encode()], 0).hashes, arrays.Words([two.encode()], 0).hashes)
    docs = spark.createDataFrame([(0, one), (1, two), (2, one)], "doc_id long, text string")
    assert {r["id"]: r["n_removed"] for r in substring.substring_dedup(docs).collect()} == {0: 0, 1: 0, 2: 14}
    # near duplicates are taken in lower case: pairs are looked for that stay apart from case
    assert {r["id"]: r["component_id"] for r in minhash.near_duplicates(docs, width=4).collect()} == {0: 0, 1: 1, 2: 0}


def test_the_key_changes_hashes_and_not_results(spark):
    words = arrays.Words([b"a few words of no great length"], arrays.fresh_key()).hashes
    assert not np.array_equal(words, arrays.Words([b"a few words of no great length"], arrays.fresh_key()).hashes) and len(set(words)) == 7
    long = b"x" * 2000
    assert arrays.Words([long + b" " + long], 5).hashes.tolist()[0] == arrays.Words([long], 5).hashes.tolist()[0] != arrays.Words([long], 6).hashes.tolist()[0]


def test_a_row_goes_by_id_and_text(spark):
    """Two rows share an id; one is a near copy of a third row, the other is like nothing."""
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "en", "s", 1), (5, base + " more", "en", "s", 1), (5, " ".join(f"u{i}" for i in range(80)), "en", "s", 1), (None, base + " less", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][:2]) for r in left) == [(0, "w0"), (1, "w0"), (5, "u0")]
    assert left[0].asDict().keys() == set(docs.columns) and docs.where(F.col("doc_id") == 5).count() == 2
