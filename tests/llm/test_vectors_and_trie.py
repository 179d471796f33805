"""Operators 11 to 13 against plain versions, on rows of every odd kind, and against their SQL."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import compression, queries, topk, trie

from ..conftest import SMALL
from ..test_oracles import rows_of

VECTORS = "vec_id long, embedding array<float>, label int, id string, vector string, n int, o0 int"


def odd_vectors(seed, n=160, width=32):
    """Rows with nulls, non-finite and missing components, ties, repeats, short vectors and a hot vector."""
    rng = random.Random(seed)
    hot = [rng.uniform(-1, 1) for _ in range(width)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(1000 + i, hot, 7) for i in range(n // 2)]
    rows += [(2000, None, 1), (2100, [math.nan] * width, 1), (2200, [None] + hot[1:], 1), (2300, [math.inf] + hot[1:], None), (2400, hot[:5], 2), (2500, [], None)]
    rows += [(5, hot, 1), (100, hot, 1), rows[7], rows[0], (None, hot, None), (-300, hot, 3), (2600, [0.0] * width, 2)]
    rng.shuffle(rows)
    return rows


def numbers(rows, factor, width):
    """(id, integers, label) of the rows that count."""
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(factor * float(np.float32(x))) for x in v] + [0] * (width - len(v)), label))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 3, 4) for r in rows], VECTORS)


def plain_codes(rows, width, entries=64, rounds=2, parts=16):
    held = sorted(numbers(rows, 256, width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = width // parts
    cut = lambda v, p: v[p * length : (p + 1) * length]
    books = [[cut(v, p) for _, v, _ in held[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in held:
            for p in range(parts):
                groups[p, assign(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if (g := groups.get((p, k))) else e for k, e in enumerate(books[p])] for p in range(parts)]
    errors, out = defaultdict(int), []
    for i, v, label in held:
        found = [assign(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        errors[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[label], digest) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize("n,width", [(160, 32), (20, 64), (160, 50)])
def test_codes_on_odd_rows(spark, tmp_path, n, width):
    rows = odd_vectors(n, n, width)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op11_segment_means"](spark, str(tmp_path))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_codes(rows, -(-width // 16) * 16)


@pytest.mark.parametrize("length,scale", [(1, 100), (2, 3), (4, 50), (7, 1000), (16, 2**24), (4, 2**27)])
def test_bounds_lose_no_entry(length, scale):
    rng = np.random.default_rng(length)
    entries = rng.integers(-scale, scale, (64, length))
    entries[10] = entries[3]  # ties go to the lower index
    x = np.concatenate([rng.integers(-scale, scale, (400, length)), entries, entries[:20] + 1])
    codes, far, taken = compression.Bounded(entries).nearest(x)
    every = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert codes.tolist() == [min(range(64), key=lambda k: (d[k], k)) for d in every] and far.tolist() == every.min(1).tolist()
    assert length not in (2, 4) or taken < 0.6 * every.size  # parts of pure noise: the longer, the less the bounds can tell


def test_huge_components_are_limited(spark, tmp_path):
    frame(spark, [(0, [3e38] * 16, 1), (1, [-3e38] * 16, 1), (100, [1.0] * 16, 1)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all(r["error"] == 0 for r in queries.QUERIES["op11_segment_means"](spark, str(tmp_path)).collect())
    best = {(r["query_id"], r["rank"]): r["vec_id"] for r in queries.QUERIES["op13_uniform_threshold"](spark, str(tmp_path)).collect()}
    assert best == {(0, 1): 100, (0, 2): 1, (100, 1): 0, (100, 2): 1}


def plain_best(rows, width, k=10, every=100):
    held, out = numbers(rows, 1024, width), []
    for q, x, _ in held:
        if q is not None and math.fmod(q, every) == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i is None, i or 0) for i, y, _ in held if i != q))
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_top_k_on_odd_rows(spark, tmp_path, monkeypatch, small):
    if small:  # many blocks of both kinds, none broadcast
        monkeypatch.setattr(topk, "VECTOR_BYTES", 1)
        monkeypatch.setattr(topk, "QUERY_BYTES", 256)
        monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    rows = odd_vectors(5, 420, 32)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op13_uniform_threshold"](spark, str(tmp_path))
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_best(rows, 32)


def test_phase_two_collects_little():
    """Of clustered vectors few entries reach the uniform threshold and survive the cutoff."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    y = (1024 * (centres[rng.integers(0, 20, 4000)] + 0.3 * rng.normal(size=(4000, 64))) / 8).astype(np.int32)
    x = y[:40]
    scores = x.astype(np.int64) @ y.T.astype(np.int64)
    scores[np.arange(40), np.arange(40)] = np.iinfo(np.int64).min
    cutoffs = np.sort(scores, axis=1)[:, -10]
    row = {"block": 0, "qs": np.arange(40).tobytes(), "q_ids": np.arange(40).tobytes(), "q_n": 40, "q_numbers": x.tobytes(), "cutoffs": cutoffs.tobytes(), "known": np.ones(40, bool).tobytes(),
           "n": 4000, "ids": np.arange(4000).tobytes(), "missing": np.zeros(4000, bool).tobytes(), "numbers": y.tobytes()}
    at, found, _, _ = topk._collected(topk._Pair(row, 4), 10)
    assert sorted(zip(at.tolist(), found.tolist())) == sorted((q, s) for q in range(40) for s in scores[q].tolist() if s >= cutoffs[q])


TURNS = "conv_id long, turn long, role string, text string, conv string, pos int, depth int, owner int"


def plain_trie(rows, stride=5, most=9):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % most
        built = turns.get(c - int(math.fmod(c, stride)), [])[:h] + turns[c][h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += not children.get(k)
    sha = lambda k: hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children.get(k, 0), leaves[k], saved[k], sha(k)) for k, m in members.items()), key=repr)


def trie_rows(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op12_owned_chains"](spark, str(tmp_path))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_on_odd_rows(spark, tmp_path, seed):
    """Shared openings, copies, ties, repeats, nulls, absent bases and a conversation longer than two blocks."""
    rng = random.Random(seed)
    lines = ["hello", "what is new", "ééé", "", None, "thanks " * 30]
    rows = []
    for c in rng.sample(range(-20, 120), 90):
        rows += [(c, rng.choice([k, k, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(lines[: rng.randint(1, 6)])) for k in range(rng.randint(1, 12))]
    copy = [("user", "same question"), ("assistant", "same answer")]
    rows += [(c, k, *t) for c in range(500, 640) for k, t in enumerate(copy)]
    long = [(k, "user", f"line {k % 7}") for k in range(150)]
    rows += [(c, k, r, t if k < 140 else f"{t} {c}") for c in (200, 203, 300, 301) for k, r, t in long]
    rows += rows[:5] + [(None, 1, "user", "nobody")]
    rng.shuffle(rows)
    assert trie_rows(spark, tmp_path, rows) == plain_trie(rows)


def test_trie_of_a_tall_path(spark, tmp_path):
    """Each conversation leaves the one before it one turn later: chains hang on chains 40 levels up."""
    rows = [(10_000 + 5 * i, k, "user", f"t{k}" if k < 20 + i else f"own {i}") for i in range(40) for k in range(22 + i)]
    assert trie_rows(spark, tmp_path, rows) == plain_trie(rows)


def test_ends_over_several_ranges(spark):
    """The ids that end at one node are hashed whole and in order, however they were dealt."""
    ends = spark.range(3000).select(F.lit(7).cast("long").alias("owner"), F.lit(2).cast("long").alias("depth"), (F.col("id") * 7919 - 5_000_000).alias("conv"))
    ids = sorted(r["conv"] for r in ends.collect())
    assert [r["sha"] for r in trie.ends_digests(ends).collect()] == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]


@pytest.mark.parametrize("name,table,schema", [("op11_segment_means", "embeddings", VECTORS), ("op13_uniform_threshold", "embeddings", VECTORS), ("op12_owned_chains", "conversations", TURNS)])
def test_empty_tables(spark, tmp_path, name, table, schema):
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op11_segment_means", "op12_owned_chains", "op13_uniform_threshold"])
def test_agrees_with_sql(spark, duck, name):
    found, said = queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLES[name])
    names = sorted(found.columns)
    assert names == sorted(said.columns)
    assert rows_of(names, found.columns, found.collect()) == rows_of(names, said.columns, said.fetchall())
