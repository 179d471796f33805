"""Thousands of documents that share a long passage and differ in about a fifth: all pairs are close, few are linked."""

from __future__ import annotations

import random

import numpy as np

from palimpsest.llm import minhash
from palimpsest.llm._shared import save

from . import brute


def matrix_components(docs, width, percent):
    """Smallest linked id of every document, from all pairs at once by a matrix product."""
    sets = {i: {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for i, t in docs for w in [brute.WORD.findall(t.lower())]}
    uses: dict = {}
    for s in sets.values():
        for x in s:
            uses[x] = uses.get(x, 0) + 1
    column = {x: k for k, x in enumerate(x for x, n in uses.items() if n > 1)}
    ids = sorted(sets)
    held = np.zeros((len(ids), len(column)), np.float32)
    for r, i in enumerate(ids):
        held[r, [column[x] for x in sets[i] if x in column]] = 1
    both, size = held @ held.T, np.array([len(sets[i]) for i in ids])
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)
    root = np.arange(len(ids))
    while True:
        least = np.where(linked, root[None, :], len(ids)).min(1)
        if (least == root).all():
            return {i: ids[r] for i, r in zip(ids, root, strict=True)}
        root = least


def test_boilerplate(spark):
    random.seed(21)
    words = lambda n: [f"w{random.randrange(10**9)}" for _ in range(n)]
    shared, docs = words(160), []
    for i in range(5000):
        own = words(random.randint(14, 60))
        docs.append((i, " ".join(shared + own)))
        if i % 100 == 0:  # a near copy, and a copy of that
            docs += [(10_000 + i, " ".join(shared + own[:-1] + ["edited"])), (20_000 + i, " ".join(shared + own[:-2] + ["edited", "twice"]))]
    expect = matrix_components(docs, 4, 80)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = {r["id"]: r["component_id"] for r in minhash.near_duplicates(table, width=4).collect()}
    assert found == expect
    assert len(set(expect.values())) > 1000


def test_candidates_of_boilerplate_stay_few(spark):
    """Documents of which more than a ninth is their own never become pairs, whatever they share."""
    random.seed(22)
    sets = [(bytes([i // 256, i % 256]), sorted(range(800)) + random.sample(range(10**6, 10**9), random.randint(110, 190))) for i in range(1500)]
    table = save(spark.createDataFrame(sets, "v binary, set array<bigint>"), "test-sets")
    alone = spark.createDataFrame([], "v binary, root binary")
    assert minhash._prefix_pairs(table, alone, 80).count() == 0
