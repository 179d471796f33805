"""Pairs of sets that share many rare shingles."""

from __future__ import annotations

import random

from palimpsest.llm import minhash


def test_a_pair_meets_at_few_of_its_shingles(spark, monkeypatch):
    rng = random.Random(5)
    base = rng.sample(range(1, 10**9), 200)
    sets = {bytes([i]): sorted(rng.sample(base, 185) + rng.sample(range(10**9, 2 * 10**9), rng.randint(0, 20))) for i in range(40)}
    sets |= {bytes([i]): sorted(rng.sample(base, 30)) for i in range(40, 60)}
    rows = spark.createDataFrame([(bytearray(v), s) for v, s in sets.items()], "v binary, set array<long>")
    grouped = spark.createDataFrame([(bytearray([i]), bytearray([i // 2 * 2])) for i in range(10)], "v binary, root binary")
    met, frame = [], type(rows)
    given = frame.distinct
    monkeypatch.setattr(frame, "distinct", lambda self: met.append(self.count()) or given(self))
    pairs = []
    for earlier in (1, 8, 64):
        monkeypatch.setattr(minhash, "EARLIER", earlier)
        pairs.append({(bytes(r["a"]), bytes(r["b"])) for r in minhash._prefix_pairs(rows, grouped, 80).collect()})
    assert pairs[0] == pairs[1] == pairs[2] and met[0] > met[1] >= met[2] and met[2] <= 2 * len(pairs[2])  # sets of one size meet both ways
    root = lambda v: bytes([v[0] // 2 * 2]) if v[0] < 10 else v
    like = lambda x, y: 180 * len(set(x) & set(y)) >= 80 * (len(x) + len(y))
    wanted = {(a, b) for a in sets for b in sets if a < b and root(a) != root(b) and like(sets[a], sets[b])}
    assert wanted and wanted <= pairs[1]
