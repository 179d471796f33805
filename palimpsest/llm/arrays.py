"""Vectorised hashing of words and bytes in Python workers, and packing of arrays into rows."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

#: The characters that separate words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _33)
    h *= _MIX1
    h ^= h >> _33
    h *= _MIX2
    h ^= h >> _33
    return h


def multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def input_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of a DataFrame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, each: int = 1 << 23) -> int:
    """Buckets so that each holds about ``each`` bytes of input, and one for every shuffle partition.

    Tasks send an array for every bucket, so more buckets mean smaller arrays.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(input_bytes(df) // each, 1 << 20))


def fresh_key() -> int:
    """128 bits drawn for one run. The driver gives them to all tasks, so tasks run again agree.

    A hash without a key can be undone: words that differ and share a hash can be
    made in advance and planted in a text. Under a key that nobody knows before the run,
    different words share a hash by chance only, once in 2^64 pairs.
    """
    return secrets.randbits(128)


class Words:
    """The words of some texts: keyed 64-bit hashes, and the first word of each text."""

    def __init__(self, texts: list[bytes], key: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        data = b"\n".join([*texts, b"        "])  # room to load eight bytes at any word
        buf = np.frombuffer(data, np.uint8)
        space = SPACE[buf]
        before = np.empty_like(space)
        before[0] = True
        before[1:] = space[:-1]
        starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.hashes = _hashed(data, starts, ends[: len(starts)], key)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, width: int, seed: int = 0) -> np.ndarray:
        """A hash for the ``width`` words from each word on; those that leave their text are rubbish."""
        n = len(self.hashes)
        total = np.zeros(n, np.uint64)
        for k, m in enumerate(multipliers(width, seed)):
            total[: max(n - k, 0)] += self.hashes[k:] * m
        return mix(total)

    def whole(self, width: int) -> np.ndarray:
        """Which windows of ``width`` words lie in their text."""
        last = np.repeat(self.first[1:], self.counts())
        return np.arange(len(self.hashes)) + width <= last


def _hashed(data: bytes, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """Eight bytes at a time, each under both halves of the key; what a key maps bijectively never collides in its first eight bytes."""
    add, times = np.uint64(key & (2**64 - 1)), np.uint64(key >> 64 | 1)
    sizes = ends - starts
    loads = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    out = np.zeros(len(starts), np.uint64)
    active, at = np.arange(len(starts)), starts
    left = sizes
    for _ in range(LONG_WORD // 8):
        if not len(active):
            break
        part = loads[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        out[active] = mix((out[active] * _MIX2 ^ part ^ add) * times)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for i in active:  # the few words longer than LONG_WORD
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key.to_bytes(16, "little")).digest(), "little")
    return mix(out ^ sizes.astype(np.uint64))


def batches_of(texts: list, size: int = 1 << 21):
    """Ranges of texts of about ``size`` characters together."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``held``."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


#: Texts on their way to a group: many of them in one compressed array.
BLOBS = "dest int, ids binary, missing binary, dids binary, sizes binary, texts binary"


def blobs(groups: int):
    """An iterator function (id, text, did) -> BLOBS: the texts of a batch for each of ``groups`` groups."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            missing, ids = batch["id"].isna().to_numpy(), batch["id"].fillna(0).to_numpy(np.int64)
            dids = batch["did"].to_numpy(np.int64)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            dest = dids % groups
            order = np.argsort(dest, kind="stable")
            cuts = runs(dest[order])
            out = []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                k = order[a:z]
                out.append((int(dest[k[0]]), ids[k].tobytes(), missing[k].tobytes(), dids[k].tobytes(), sizes[k].tobytes(), press.compress(b"".join([texts[i] for i in k]))))
            yield pd.DataFrame(out, columns=["dest", "ids", "missing", "dids", "sizes", "texts"])

    return pack


def unpacked(rows: pd.DataFrame) -> tuple[list, np.ndarray, list[bytes]]:
    """Ids (None where missing), document keys and texts of some BLOBS."""
    ids, dids, texts = [], [], []
    for r in rows.itertuples():
        missing = np.frombuffer(r.missing, bool).tolist()
        ids += [None if m else i for i, m in zip(np.frombuffer(r.ids, np.int64).tolist(), missing, strict=True)]
        dids.append(np.frombuffer(r.dids, np.int64))
        data, at = zstandard.ZstdDecompressor().decompress(r.texts, max_output_size=1 << 31), 0
        for n in np.frombuffer(r.sizes, np.int64).tolist():
            texts.append(data[at : at + n])
            at += n
    return ids, np.concatenate(dids) if dids else np.zeros(0, np.int64), texts
