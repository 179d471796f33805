"""Suffix-array deduplication with a logarithmic family of indexes.

A match is a string of 200 bytes that starts at two places or more. Suffixes are
sampled: in every 200-byte window the smallest 32-byte hash marks one anchor (the
leftmost of equal ones), so equal windows have equal anchors at equal offsets. The
windows with one anchor are a run of consecutive starts; the suffix at the anchor,
as far as the run's last window reaches, and the bytes before it back to the run's
first are one entry. (All suffixes of all bytes would take far more than the input
allows; about one in 85 is sampled, and no window is without one.)

1. Anchors that occur twice anywhere are found by the hashes of their 32 bytes. This
   only selects: equal bytes have equal hashes, so nothing is lost.
2. A batch (the texts of one group) sorts the entries of those anchors by their bytes,
   the suffix first: the suffix array of the batch. It is cut into ranges by
   anchor and sent, one entry for each distinct stretch of text.
3. Index family, for each range: the suffix array of a new batch is merge-scanned
   against the existing levels. Equal entries are matched whole; entries beside each
   other that share the anchor only are noted. The batch then becomes the newest
   level, and levels of about equal size merge, so n batches make at most log n
   levels and every entry is merged at most log n times.
4. Noted anchors mark the ends of matches. The common prefixes of neighbours in the
   merged suffix array, and of neighbours in the array of the bytes before, tell for each
   window which entries agree on all its bytes. All comparisons are of bytes.
5. Each batch gets back, in the order of its suffix array, which entries are matched
   whole and which windows of the others, and removes those bytes.

Exchanges carry arrays. A passage in a third of all documents costs each batch one
entry. Texts are shuffled once, compressed, by a hash of (doc_id, text) and read twice
from that exchange. Long texts are worked on in overlapping pieces, so memory does
not grow with them beyond the text itself.

Defined results: texts are UTF-8 bytes, a null text has none; nothing crosses
documents; repeated rows match each other like any two documents; texts below 200
bytes lose nothing. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import col, text_or_empty
from .arrays import BLOBS, among, batches_of, blobs, buckets_for, mix, multipliers, runs, unpacked

LENGTH, ANCHOR = 200, 32
#: Most bytes of a run before its anchor; an entry is LENGTH bytes from the anchor on and BACK before it, filled with zeros.
BACK = LENGTH - ANCHOR
WIDTH = LENGTH + BACK
ENTRY = f"S{WIDTH}"
#: Low bits of a sort key that hold the place in a piece; windows that start in one piece of a text.
_MASK = np.uint64((1 << 28) - 1)
PIECE = 1 << 20
#: Heads that a task merges before it sends them on; runs whose entries are in memory at once.
MERGED, SLICE = 1 << 19, 1 << 15
_HEADS = "bucket int, heads binary, dests binary, shared binary"
_TOLD_HEADS = "dest int, heads binary"
_ARRAYS = "bucket int, dest int, entries binary, n int, heads binary"
_TOLD = "dest int, bucket int, whole binary, some binary, windows binary, heads binary"


class Runs:
    """Runs of windows with a common anchor, over some pieces of text."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        data = b"\0".join([*pieces, bytes(ANCHOR)])
        usable = len(data) - ANCHOR + 1
        loads = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
        gram = np.zeros(usable, np.uint64)
        for k, m in enumerate(multipliers(ANCHOR // 8, 5)):
            gram += loads[8 * k : 8 * k + usable] * m
        gram = mix(gram)
        owner_end = np.repeat(self.begin[1:] - 1, sizes)
        starts = np.flatnonzero(np.arange(len(owner_end)) + LENGTH <= owner_end)
        anchor = _anchors(gram)[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        self.low = starts[first]
        self.high = starts[np.append(first[1:], len(starts)) - 1] if len(first) else starts
        self.anchor = anchor[first]
        self.owner = np.searchsorted(self.begin, self.low, "right") - 1
        self.head = gram[self.anchor]


def _anchors(gram: np.ndarray) -> np.ndarray:
    """Place of the smallest 32-byte hash in the window from each byte on (block prefix and suffix minima)."""
    width, n = LENGTH - ANCHOR + 1, len(gram)
    keys = (gram & ~_MASK) | np.arange(n, dtype=np.uint64)
    padded = np.full((-(-n // width) + 1) * width, np.iinfo(np.uint64).max)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _MASK).astype(np.int64)


def all_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, low, high, anchor, head) of the runs of all texts, places counted within the text.

    A text longer than PIECE is read in pieces that overlap by a window less one byte;
    a run that goes on over a border becomes two, which the comparison of windows allows for.
    """
    pieces = [(i, at, t[at : at + PIECE + LENGTH - 1]) for i, t in enumerate(texts) if len(t) >= LENGTH for at in range(0, len(t) - LENGTH + 1, PIECE)]
    for a, z in batches_of([p for _, _, p in pieces], PIECE):
        r = Runs([p for _, _, p in pieces[a:z]])
        shift = np.array([at for _, at, _ in pieces[a:z]], np.int64)[r.owner] - r.begin[r.owner]
        yield np.array([i for i, _, _ in pieces[a:z]], np.int64)[r.owner], r.low + shift, r.high + shift, r.anchor + shift, r.head


def _by(keys: np.ndarray, order: np.ndarray):
    order = order[np.argsort(keys[order], kind="stable")]
    cuts = runs(keys[order])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(keys[order[a]]), order[a:z]


def _bytes(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(a.tobytes())


def _read(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed, max_output_size=1 << 31), kind) if packed else np.zeros(0, kind)


# --- 1: anchors that occur twice ---


def _send(buckets: int):
    def rows(heads: np.ndarray, dests: np.ndarray) -> pd.DataFrame:
        order = np.argsort(heads, kind="stable")
        heads, dests = heads[order], dests[order]
        cuts = runs(heads)
        sizes = np.diff(cuts)
        many = np.repeat(sizes > 1, sizes)  # their groups need not wait for other tasks
        out = [(buckets + d, np.unique(heads[k]).tobytes(), b"", b"") for d, k in _by(dests, np.flatnonzero(many))]
        first = cuts[:-1]
        shared = np.zeros(len(heads), bool)
        shared[first] = sizes > 1
        for b, k in _by((heads % np.uint64(buckets)).astype(np.int64), first):
            s = shared[k]
            out.append((b, heads[k[~s]].tobytes(), dests[k[~s]].astype(np.int32).tobytes(), heads[k[s]].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "heads", "dests", "shared"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts, dests = [t.encode() for t in batch["text"]], batch["did"].to_numpy(np.int64) % buckets
            for text, _, _, _, head in all_runs(texts):
                held.append((head, dests[text]))
                if sum(len(h) for h, _ in held) >= MERGED:
                    yield rows(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield rows(*map(np.concatenate, zip(*held, strict=True)))

    return send


def _twice(buckets: int):
    def match(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] >= buckets:
            return pd.DataFrame({"dest": group["bucket"] - buckets, "heads": group["heads"]})
        heads = np.concatenate([np.frombuffer(x, np.uint64) for x in group["heads"]])
        dests = np.concatenate([np.frombuffer(x, np.int32) for x in group["dests"]])
        known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group["shared"]]))
        order = np.argsort(heads, kind="stable")
        sizes = np.diff(runs(heads[order]))
        many = np.empty(len(heads), bool)
        many[order] = np.repeat(sizes > 1, sizes)
        told = np.flatnonzero(many | among(heads, known))
        return pd.DataFrame([(d, heads[k].tobytes()) for d, k in _by(dests, told)], columns=["dest", "heads"])

    return match


# --- 2: the suffix array of a batch ---


class Batch:
    """The texts of a group and the runs whose anchors occur twice."""

    def __init__(self, texts: list[bytes], told: np.ndarray):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = BACK + np.concatenate([[0], np.cumsum(sizes)])
        # every byte one more, so that zero fills what an entry lacks: UTF-8 has no byte 255
        self.data = np.frombuffer(b"".join([bytes(BACK), b"\xff".join(texts), bytes(LENGTH)]), np.uint8) + np.uint8(1)
        parts = []
        for text, low, high, anchor, head in all_runs(texts):
            k = np.flatnonzero(among(head, told))
            at = self.begin[text[k]]
            parts.append((low[k] + at, high[k] + at, anchor[k] + at, head[k]))
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        self.low, self.high, self.anchor, self.head = map(np.concatenate, zip(empty, *parts, strict=True))

    def entries(self, k: np.ndarray) -> np.ndarray:
        out = np.empty((len(k), WIDTH), np.uint8)
        view = np.lib.stride_tricks.sliding_window_view
        out[:, :LENGTH] = view(self.data, LENGTH)[self.anchor[k]]
        out[:, LENGTH:] = view(self.data, BACK)[self.anchor[k] - BACK][:, ::-1]
        out[:, :LENGTH][np.arange(LENGTH) >= (self.high[k] + LENGTH - self.anchor[k])[:, None]] = 0
        out[:, LENGTH:][np.arange(BACK) >= (self.anchor[k] - self.low[k])[:, None]] = 0
        return out.view(ENTRY).ravel()

    def arrays(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each range: sorted distinct entries, which of them occur twice here, the runs, and the entry of each run."""
        bucket = (self.head % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts, at = runs(bucket[order]), 0
        while at < len(cuts) - 1:
            end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SLICE, "right")) - 1)
            k = order[cuts[at] : cuts[end]]
            found = self.entries(k)
            place = np.argsort(found, kind="stable")
            for b, p in _by(bucket[k], place):
                s = found[p]
                new = np.ones(len(s), bool)
                new[1:] = s[1:] != s[:-1]
                yield b, s[new], np.diff(np.append(np.flatnonzero(new), len(s))) > 1, k[p], np.cumsum(new) - 1
            at = end


def _extend(buckets: int):
    def extend(docs: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "dest", "entries", "n", "heads"]
        if not len(docs) or not len(flags):
            return pd.DataFrame([], columns=names)
        dest = int(docs["dest"].iloc[0])
        told = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in flags["heads"]]))
        batch = Batch(unpacked(docs)[2], told)
        out = [(b, dest, _bytes(entries), len(entries), b"") for b, entries, _, _, _ in batch.arrays(buckets)]
        return pd.DataFrame([*out, (buckets + dest, dest, b"", 0, _bytes(told))], columns=names)

    return extend


# --- 3 and 4: the index family and the windows at the ends of matches ---


def _heads(entries: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(entries.view(np.uint8).reshape(-1, WIDTH)[:, :ANCHOR]).view(f"S{ANCHOR}").ravel()


class LevelFamily:
    """Levels of sorted distinct entries, each with the number that first brought it."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, entries: np.ndarray, numbers: np.ndarray):
        """Scan the suffix array of a batch against the levels, then insert it.

        Yields, for each level, the numbers of equal entries (of the batch and of the level)
        and the anchors that both have with different entries.
        """
        heads = _heads(entries)
        for held, old in self.levels:
            at = np.searchsorted(held, entries)
            here = np.minimum(at, len(held) - 1)
            equal = held[here] == entries
            beside = np.zeros(len(entries), bool)
            for place in (here, np.maximum(at - 1, 0), np.minimum(at + 1, len(held) - 1)):  # suffixes with a common prefix stand beside each other
                beside |= (_heads(held[place]) == heads) & (held[place] != entries)
            yield numbers[equal], old[here[equal]], heads[beside]
        if len(entries):
            self.levels.append((entries, numbers))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self._merge()

    def _merge(self) -> None:
        newer, older = self.levels.pop(), self.levels.pop()
        entries, numbers = (np.concatenate(x) for x in zip(older, newer, strict=True))
        order = np.argsort(entries, kind="stable")  # merges two runs; of equal entries the older stays
        entries, numbers = entries[order], numbers[order]
        keep = np.ones(len(entries), bool)
        keep[1:] = entries[1:] != entries[:-1]
        self.levels.append((entries[keep], numbers[keep]))

    def whole(self) -> np.ndarray:
        """All distinct entries, sorted."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0][0] if self.levels else np.zeros(0, ENTRY)


def _common(rows: np.ndarray) -> np.ndarray:
    """Common prefix of every row with the row before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    for a in range(1, len(rows), 1 << 15):
        differ = rows[a : a + (1 << 15)] != rows[a - 1 : a - 1 + len(rows[a : a + (1 << 15)])]
        out[a : a + len(differ)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def repeated_windows(entries: np.ndarray) -> np.ndarray:
    """For sorted distinct entries: bit j says that the window j bytes before the anchor is in two entries."""
    rows = entries.view(np.uint8).reshape(-1, WIDTH)
    forward, back = rows[:, :LENGTH], np.ascontiguousarray(rows[:, LENGTH:])
    reach, room = (forward != 0).sum(1), (back != 0).sum(1)
    by_back = np.argsort(back.view(f"S{BACK}").ravel(), kind="stable")
    lcp, lcp_back = _common(forward), _common(back[by_back])
    out = np.zeros((len(rows), BACK + 1), bool)
    behind = np.empty(len(rows), np.int64)
    for j in range(BACK + 1):
        k = np.flatnonzero((room >= j) & (reach >= LENGTH - j))
        if len(k) > 1:
            ahead = np.cumsum(lcp < LENGTH - j)  # equal for entries that agree on so many bytes from the anchor on
            behind[by_back] = np.cumsum(lcp_back < j)  # and on j bytes before it
            key = ahead[k] * (len(rows) + 1) + behind[k]
            order = np.argsort(key, kind="stable")
            sizes = np.diff(runs(key[order]))
            out[k[order], j] = np.repeat(sizes > 1, sizes)
    return out


def _match(buckets: int):
    def match(group: pd.DataFrame) -> pd.DataFrame:
        names = ["dest", "bucket", "whole", "some", "windows", "heads"]
        if group["bucket"].iloc[0] >= buckets:
            return group.assign(whole=b"", some=b"", windows=b"")[names]
        group = group.sort_values("dest")
        arrays = [_read(r.entries, ENTRY) for r in group.itertuples()]
        first = np.concatenate([[0], np.cumsum(group["n"].to_numpy(np.int64))])
        family, hit, noted = LevelFamily(), np.zeros(first[-1], bool), [np.zeros(0, f"S{ANCHOR}")]
        for i, entries in enumerate(arrays):
            for mine, theirs, mixed in family.add(entries, np.arange(first[i], first[i + 1])):
                hit[mine] = True
                hit[theirs] = True
                noted.append(mixed)
            heads = _heads(entries)
            noted.append(heads[1:][heads[1:] == heads[:-1]])
        mixed = np.unique(np.concatenate(noted))
        every = family.whole()
        if len(mixed):
            every = every[among(_heads(every), mixed)]
            windows = repeated_windows(every)
        out = []
        for i, entries in enumerate(arrays):
            own = hit[first[i] : first[i + 1]]  # an older number may stand for several batches, so each looks itself up
            some, bits = np.zeros(0, np.int32), b""
            if len(mixed):
                k = np.flatnonzero(among(_heads(entries), mixed))
                found = windows[np.searchsorted(every, entries[k])]
                k, found = k[found.any(1)], found[found.any(1)]
                some, bits = k.astype(np.int32), np.packbits(found, 1).tobytes()
            if own.any() or len(some):
                out.append((int(group["dest"].iloc[i]), int(group["bucket"].iloc[i]), np.packbits(own).tobytes(), some.tobytes(), bits, b""))
        return pd.DataFrame(out, columns=names)

    return match


# --- 5: removal ---


def _remove(buckets: int, with_text: bool):
    def gone_of(texts: list[bytes], told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
        heads = [_read(x, np.uint64) for x in told["heads"] if x]
        if not heads:
            return None
        batch = Batch(texts, np.concatenate(heads))
        cover = np.zeros(len(batch.data) + 1, np.int32)
        answers = {int(r.bucket): r for r in told.itertuples() if r.bucket < buckets}
        for b, entries, twice, k, number in batch.arrays(buckets):
            whole, r = twice.copy(), answers.get(b)
            if r is not None:
                whole |= np.unpackbits(np.frombuffer(r.whole, np.uint8), count=len(entries)).astype(bool)
            full = k[whole[number]]
            np.add.at(cover, batch.low[full], 1)
            np.add.at(cover, batch.high[full] + LENGTH, -1)
            some = np.frombuffer(r.some, np.int32) if r is not None else ()
            if len(some):
                row = np.full(len(entries), -1)
                row[some] = np.arange(len(some))
                bits = np.unpackbits(np.frombuffer(r.windows, np.uint8).reshape(len(some), -1), axis=1, count=BACK + 1)
                part = np.flatnonzero((row[number] >= 0) & ~whole[number])
                which, j = np.nonzero(bits[row[number[part]]])
                starts = batch.anchor[k[part[which]]] - j
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + LENGTH, -1)
        return np.cumsum(cover) > 0, batch.begin

    def remove(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, _, texts = unpacked(docs)
        found, rows = gone_of(texts, told) if len(told) else None, []
        for i, text in enumerate(texts):
            spans, kept = 0, text
            if found is not None:
                own = found[0][found[1][i] : found[1][i] + len(text)]
                if own.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8)))
                    spans = len(edges) // 2
                    bounds = [0, *edges.tolist(), len(text)]
                    kept = b"".join(text[bounds[k] : bounds[k + 1]] for k in range(0, len(bounds), 2))
            rows.append((ids[i], len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        frame = pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])
        return frame.astype({"id": "Int64"})

    return remove


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    buckets = buckets_for(docs)
    text = text_or_empty(text_col)
    rows = docs.select(col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(col(id_col), text).alias("did"))
    heads = rows.select("did", "text").mapInPandas(_send(buckets), _HEADS)
    flags = heads.groupBy("bucket").applyInPandas(_twice(buckets), _TOLD_HEADS)
    placed = rows.mapInPandas(blobs(buckets), BLOBS)
    arrays = placed.groupBy("dest").cogroup(flags.groupBy("dest")).applyInPandas(_extend(buckets), _ARRAYS)
    told = arrays.groupBy("bucket").applyInPandas(_match(buckets), _TOLD)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return placed.groupBy("dest").cogroup(told.groupBy("dest")).applyInPandas(_remove(buckets, with_text), schema)


def op5_suffix_family(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")
