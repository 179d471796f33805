"""Registered queries that SQL cannot express, against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import pytest

from palimpsest.llm import language, packing, queries, sharding
from palimpsest.llm.tokens import vocabulary

from . import brute
from ..conftest import SMALL


def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


def test_op1(spark, monkeypatch):
    """Every cut is the weighted median of the node's widest dimension, found here by sorting."""
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in sharding._narrow(docs, "doc_id", "text", ["source", "lang", "n_chars"]).collect()]
    expect = {}

    def split(held, shards, first):
        if shards == 1:
            expect.update({r["id"]: first for r in held})
            return
        wide = max(range(3), key=lambda d: max(r[f"k{d}"] >> 36 for r in held) - min(r[f"k{d}"] >> 36 for r in held))
        held = sorted(held, key=lambda r: r[f"k{wide}"])
        want, before, cut = sum(r["size"] for r in held) * (shards // 2) / shards, 0, None
        for key, group in itertools.groupby(held, key=lambda r: r[f"k{wide}"]):
            weight = sum(r["size"] for r in group)
            if before + weight > want:
                cut = key + (before + weight - want < want - before)
                break
            before += weight
        left = [r for r in held if r[f"k{wide}"] < cut]
        split(left, shards // 2, first)
        split(held[len(left) :], shards - shards // 2, first + shards // 2)

    split(rows, 16, 0)
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark)}
    slots: dict = {}
    for r in queries.QUERIES["op1_kd_sharding"](spark, SMALL).collect():
        t = texts[r["doc_id"]].encode()
        assert (r["shard"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (expect[r["doc_id"]], len(t) + 1, zlib.crc32(t), "bytes", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, slots.values())) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("query,plain", [("op5_suffix_family", brute.suffix), ("op7_coordinate_join", brute.near)])
def test_op5_and_op7(spark, query, plain):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark)]
    assert sorted(map(tuple, queries.QUERIES[query](spark, SMALL).collect())) == plain(docs)


def test_op2(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark)}
    found = queries.QUERIES["op2_chunk_reuse"](spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))


def fewest(sizes, capacity):
    """The least number of bins, by trying every place of every piece."""
    best = len(sizes)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for i in range(len(free)):
            if free[i] >= sizes[k] and free[i] not in free[:i]:
                place(k + 1, [*free[:i], free[i] - sizes[k], *free[i + 1 :]])
        place(k + 1, [*free, capacity - sizes[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_op6_needs_as_few_sequences_as_any(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(1, 60) for _ in range(r.randint(1, 9))), reverse=True)
    lengths: dict = {}
    for s in sizes:
        lengths[s] = lengths.get(s, 0) + 1
    assert packing.plan_lengths(lengths, 60)[0] == fewest(sizes, 60)


def test_op6(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    expect, total = set(), 0
    for d in documents(spark):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            expect.add((d["doc_id"], p, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    found = queries.QUERIES["op6_linear_grouping"](spark, SMALL).collect()
    assert len(found) == len(expect) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == expect
    held: dict = {}
    for r in found:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(held) == -(-total // 4096)  # no packing can have fewer


def test_op9(spark):
    """Sums over all segmentations letter by letter, with the learned probabilities, for the registered query."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.train(docs, "doc_id", "text", "lang", vocabulary("piece_bpe_32k.model"))
    names = language.letter_pieces(vocabulary("piece_bpe_32k.model"))
    chance = dict(zip(names, model.table[:-1].tolist(), strict=True))
    most = max(map(len, names))
    known: dict = {}

    def logs(word):
        if word not in known:
            sums = [[1.0] * len(model.languages)]
            for j in range(1, len(word) + 1):
                now = [0.0] * len(model.languages)
                for i in range(max(0, j - most), j):
                    p = chance.get(word[i:j]) or ([language.UNKNOWN] * len(now) if j - i == 1 else None)
                    if p:
                        now = [n + s * q for n, s, q in zip(now, sums[i], p, strict=True)]
                sums.append(now)
            known[word] = [math.log(max(x, 1e-300)) for x in sums[-1]]
        return known[word]

    found = {r["doc_id"]: r for r in queries.QUERIES["op9_unigram_language"](spark, SMALL).collect()}
    rows = documents(spark)
    assert len(found) == len(rows)
    for d in rows:
        r = found[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        words = [language.MARK + w for w in re.findall(r"[^\W\d_]+", (d["text"] or "").lower())]
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = [sum(x) for x in zip(*map(logs, words), strict=True)]
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        assert r["lang_pred"] == model.languages[best]
        assert r["score"] == pytest.approx(1 / sum(math.exp(min(0.0, x - total[best])) for x in total), rel=1e-6)
