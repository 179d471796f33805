"""Substring deduplication with difference-cover anchors.

A window is 13 consecutive words. Two equal windows at words i and j of two
texts contain, for some shift below 7, words i + shift and j + shift whose
positions both lie in the cover {1, 2, 4} modulo 7: every difference modulo 7 is a
difference of two members. The 7 words from there on are an anchor, and lie in
the window. So it is enough to hash 3 of 7 positions to meet every match.

1. Anchors are hashed; an anchor that two documents or more contain is shared.
2. Extension: only windows that hold a shared anchor of their document are hashed
   in full (96 bits). The smallest doc_id with each window is found.
3. A window that also starts in a document with a smaller doc_id removes its words.

Hashes are keyed, with a key drawn for each run: words that were made to share a hash
don't. By chance a word takes another's place once in 2^64 pairs, and then only
where the other twelve words of a window agree.

Exchanges carry arrays, not rows. Before each of them equal hashes are merged
within the task (anchors: shared or not; windows: smallest doc_id), so a
passage that a third of all documents hold costs each task one entry. Texts are
shuffled once, compressed, by a hash of (doc_id, text); steps 2 and 3 read the
same exchange.
Groups are buckets of hashes, as many as the size of the input asks for.

Defined results: a null text has no words. Documents with equal doc_id (repeated
rows) remove nothing from each other; a null doc_id counts as the largest. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import col, text_or_empty
from .arrays import BLOBS, Words, among, batches_of, blobs, buckets_for, fresh_key, mix, runs, unpacked

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Anchors that a task merges before it sends them on.
MERGED = 1 << 20
_ROW = "bucket int, hashes binary, dids binary, counts binary, shared binary"
_FLAGS = "dest int, hashes binary, dids binary, counts binary"
_WINDOWS = "bucket int, dest int, hashes binary, tails binary, ids binary"
_NO_ID = np.iinfo(np.int64).max


def _by(keys: np.ndarray, order: np.ndarray):
    """(key, indices) for each key, from indices sorted by key."""
    cuts = runs(keys[order])
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(keys[order[a]]), order[a:z]


def _listed(hashes: np.ndarray, dids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Hashes by document, the documents, and how many each has; both sorted by document."""
    cuts = runs(dids)
    return hashes.tobytes(), dids[cuts[:-1]].tobytes(), np.diff(cuts).astype(np.uint32).tobytes()


def _unlisted(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.hashes, np.uint64), np.repeat(np.frombuffer(row.dids, np.int64), np.frombuffer(row.counts, np.uint32))


def anchors_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, hash and text of every anchor."""
    owners = words.owners()
    place = np.arange(len(owners)) - words.first[owners]
    at = np.flatnonzero(_IN_COVER[place % PERIOD] & words.whole(ANCHOR))
    return at, words.windows(ANCHOR)[at], owners[at]


def _send_anchors(buckets: int, key: int):
    def rows(hashes: np.ndarray, dids: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((dids, hashes))
        hashes, dids = hashes[order], dids[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (dids[1:] != dids[:-1])
        hashes, dids = hashes[fresh], dids[fresh]
        cuts = runs(hashes)
        many = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
        out = []
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        shared = np.zeros(len(hashes), bool)
        shared[cuts[:-1]] = np.diff(cuts) > 1  # one entry for each
        kept = np.flatnonzero(~many | shared)
        for b, k in _by(bucket, kept[np.lexsort((dids[kept], bucket[kept]))]):
            s = shared[k]
            out.append((b, *_listed(hashes[k[~s]], dids[k[~s]]), hashes[k[s]].tobytes()))
        told = np.flatnonzero(many)  # these documents need not wait for other tasks
        dest = dids % buckets
        for d, k in _by(dest, told[np.lexsort((dids[told], dest[told]))]):
            out.append((buckets + d, *_listed(hashes[k], dids[k]), b""))
        return pd.DataFrame(out, columns=["bucket", "hashes", "dids", "counts", "shared"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            texts, dids = [t.encode() for t in batch["text"]], batch["did"].to_numpy(np.int64)
            for a, z in batches_of(texts):
                _, hashes, owner = anchors_of(Words(texts[a:z], key))
                held.append((hashes, dids[a:z][owner]))
                if sum(len(h) for h, _ in held) >= MERGED:
                    yield rows(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield rows(*map(np.concatenate, zip(*held, strict=True)))

    return send


def _match_anchors(buckets: int):
    def match(group: pd.DataFrame) -> pd.DataFrame:
        names = ["dest", "hashes", "dids", "counts"]
        if group["bucket"].iloc[0] >= buckets:
            return group.assign(dest=group["bucket"] - buckets)[names]
        single = [_unlisted(r) for r in group.itertuples()]
        hashes, dids = map(np.concatenate, zip(*single, strict=True))
        known = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in group["shared"]]))
        order = np.argsort(hashes)
        cuts = runs(hashes[order])
        many = np.empty(len(hashes), bool)
        many[order] = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
        told = np.flatnonzero(many | np.isin(hashes, known))
        dest = dids % buckets
        out = [(d, *_listed(hashes[k], dids[k])) for d, k in _by(dest, told[np.lexsort((dids[told], dest[told]))])]
        return pd.DataFrame(out, columns=names)

    return match


def _joint(hashes: np.ndarray, dids: np.ndarray) -> np.ndarray:
    return mix(hashes + dids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 further bits of the windows that start at words ``at``."""
    return words.windows(WINDOW, 1)[at], (words.windows(WINDOW, 2)[at] >> np.uint64(32)).astype(np.uint32)


def _order(ids: list) -> np.ndarray:
    return np.array([_NO_ID if i is None else i for i in ids], np.int64)


def _smallest(hashes: np.ndarray, tails: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, where equal hashes begin, and the smallest id of each."""
    order = np.lexsort((tails, hashes))
    h, t = hashes[order], tails[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(new)
    return order, begin, np.minimum.reduceat(ids[order], begin) if len(begin) else ids[:0]


def _extend(buckets: int, key: int):
    def extend(docs: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "dest", "hashes", "tails", "ids"]
        if not len(docs) or not len(flags):
            return pd.DataFrame([], columns=names)
        dest = int(docs["dest"].iloc[0])
        told = np.unique(np.concatenate([_joint(*_unlisted(r)) for r in flags.itertuples()]))
        ids, dids, texts = unpacked(docs)
        ids, found = _order(ids), []
        for a, z in batches_of(texts):
            words = Words(texts[a:z], key)
            at, hashes, owner = anchors_of(words)
            at = at[among(_joint(hashes, dids[a:z][owner]), told)]
            near = np.zeros(len(words.hashes) + 1, np.int64)  # windows that start at most 6 words before a shared anchor
            np.add.at(near, np.maximum(at - (PERIOD - 1), 0), 1)
            np.add.at(near, at + 1, -1)
            starts = np.flatnonzero((np.cumsum(near[:-1]) > 0) & words.whole(WINDOW))
            found.append((*window_hashes(words, starts), ids[a:z][words.owners()[starts]]))
        hashes, tails, owner = map(np.concatenate, zip(*found, strict=True))
        order, begin, least = _smallest(hashes, tails, owner)
        hashes, tails, owner = hashes[order], tails[order], owner[order]
        most = np.maximum.reduceat(owner, begin) if len(begin) else owner[:0]
        hashes, tails = hashes[begin], tails[begin]
        out = []
        inside = np.flatnonzero(most > least)  # decided here, whatever other groups hold
        if len(inside):
            out.append((buckets + dest, dest, hashes[inside].tobytes(), tails[inside].tobytes(), least[inside].tobytes()))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        for b, k in _by(bucket, np.lexsort((least, bucket))):
            out.append((b, dest, hashes[k].tobytes(), tails[k].tobytes(), least[k].tobytes()))
        return pd.DataFrame(out, columns=names)

    return extend


def _match_windows(buckets: int):
    def match(group: pd.DataFrame) -> pd.DataFrame:
        names = ["dest", "hashes", "tails", "ids"]
        if group["bucket"].iloc[0] >= buckets or len(group) == 1:
            return group[names] if group["bucket"].iloc[0] >= buckets else pd.DataFrame([], columns=names)
        parts = [(np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.tails, np.uint32), np.frombuffer(r.ids, np.int64)) for r in group.itertuples()]
        hashes, tails, ids = map(np.concatenate, zip(*parts, strict=True))
        dest = np.repeat(group["dest"].to_numpy(np.int64), [len(p[0]) for p in parts])
        order, begin, least = _smallest(hashes, tails, ids)
        sizes = np.diff(np.append(begin, len(hashes)))
        first = np.empty(len(hashes), np.int64)
        first[order] = np.repeat(least, sizes)
        told = np.flatnonzero(first < ids)  # a group with the smallest id itself has decided already
        out = [(d, hashes[k].tobytes(), tails[k].tobytes(), first[k].tobytes()) for d, k in _by(dest, told[np.argsort(dest[told], kind="stable")])]
        return pd.DataFrame(out, columns=names)

    return match


def _remove(with_text: bool, key: int):
    def remove(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names, _, texts = unpacked(docs)
        ids, rows = _order(names), []
        parts = [(np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.tails, np.uint32), np.frombuffer(r.ids, np.int64)) for r in told.itertuples()]
        if parts:
            hashes, tails, firsts = map(np.concatenate, zip(*parts, strict=True))
            order, begin, firsts = _smallest(hashes, tails, firsts)
            keys = mix(hashes[order][begin] ^ (tails[order][begin].astype(np.uint64) << np.uint64(32)))
            full = (hashes[order][begin], tails[order][begin])
            by_key = np.argsort(keys)
            keys = keys[by_key]
        for a, z in batches_of(texts):
            gone = None
            if parts:
                words = Words(texts[a:z], key)
                starts = np.flatnonzero(words.whole(WINDOW))
                h, t = window_hashes(words, starts)
                near = np.searchsorted(keys, mix(h ^ (t.astype(np.uint64) << np.uint64(32))))
                row = by_key[np.minimum(near, len(keys) - 1)]
                hit = (full[0][row] == h) & (full[1][row] == t) & (firsts[row] < ids[a:z][words.owners()[starts]])
                cover = np.zeros(len(words.hashes) + WINDOW + 1, np.int32)
                np.add.at(cover, starts[hit], 1)
                np.add.at(cover, starts[hit] + WINDOW, -1)
                gone = np.cumsum(cover)[: len(words.hashes)] > 0
            for i in range(a, z):
                kept = texts[i].split()
                n = len(kept)
                if gone is not None:
                    own = gone[words.first[i - a] : words.first[i - a + 1]]
                    if own.any():
                        kept = [w for w, g in zip(kept, own.tolist(), strict=True) if not g]
                text = b" ".join(kept)
                rows.append((names[i], n, n - len(kept), hashlib.sha256(text).hexdigest(), *([text.decode()] if with_text else [])))
        frame = pd.DataFrame(rows, columns=["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])])
        return frame.astype({"id": "Int64"})

    return remove


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (and kept_text) of every row."""
    buckets, key = buckets_for(docs), fresh_key()
    text = text_or_empty(text_col)
    rows = docs.select(col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(col(id_col), text).alias("did"))
    anchors = rows.select("did", "text").mapInPandas(_send_anchors(buckets, key), _ROW)
    flags = anchors.groupBy("bucket").applyInPandas(_match_anchors(buckets), _FLAGS)
    placed = rows.mapInPandas(blobs(buckets), BLOBS)
    windows = placed.groupBy("dest").cogroup(flags.groupBy("dest")).applyInPandas(_extend(buckets, key), _WINDOWS)
    told = windows.groupBy("bucket").applyInPandas(_match_windows(buckets), "dest int, hashes binary, tails binary, ids binary")
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return placed.groupBy("dest").cogroup(told.groupBy("dest")).applyInPandas(_remove(with_text, key), schema)


def op4_difference_cover(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")


OP4_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first_id FROM x) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
g AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda v, k: NOT list_contains(js, k)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
