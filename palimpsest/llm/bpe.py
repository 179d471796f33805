"""Byte-level BPE with content-defined chunk reuse.

1. A text is cut where a rolling hash of its last eight bytes says so, so equal
   passages are cut alike wherever they lie; a chunk that would be longer than
   MOST_CHUNK is cut by counting from where it starts. The core of a chunk reaches from its
   first to its last word boundary (a letter or digit followed by a space), where
   encoding never depends on what lies on the other side.
2. Digests of cores are counted over all documents. Cores met twice or more are
   shared; one document owns each of them.
3. Every document is encoded but for the shared cores that others own; owners hand
   the ids of theirs on. So each shared core is encoded once in the whole job.
4. Joins: what lies between two cores, from the last boundary of a chunk to the
   first of the next, is encoded afresh as one string. Where a chunk holds no
   boundary the string grows over further chunks until one is found on both
   sides. The sequence then agrees exactly with encoding the whole text.

Texts are shuffled once, by a digest of (id, text), to meet the list of their shared
cores; ids travel only for shared cores. Ids are met through ``join_dealt``: what is broadcast are
digests, owners and numbers of at most HOT_GROUPS hot cores, never ids.

Defined results: a null text is the empty text, without ids; special tokens in a
text are encoded as the tokenizers library does; repeated rows give equal rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import col, join_dealt, join_groups, save, text_or_empty
from .arrays import batches_of
from .tokens import ByteEncoder, byte_encoder, vocabulary

#: One cut in 2^CUT_BITS bytes on average.
CUT_BITS = 10
#: Where no cut falls for so many bytes (periodic text), chunks end all the same.
MOST_CHUNK = 1 << 15
#: Shorter cores are not worth a digest.
LEAST_CORE = 64
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_DONE = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _shortened(starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Starts of chunks of at most ``most`` bytes: a longer one is cut by counting from its own start."""
    pieces = -(-(ends - starts) // most)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + (np.arange(len(first)) - first) * most


def segments(texts: list[bytes], most: int = MOST_CHUNK) -> list[list[tuple[int, int, bool]]]:
    """(start, end, is a core) of each segment of each text; segments tile the text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.concatenate([[0], np.cumsum(sizes)])
    data = b"\0".join([*texts, bytes(8)])
    buf = np.frombuffer(data, np.uint8)
    bound = np.flatnonzero((buf[1:] == 0x20) & _ALNUM[buf[:-1]]) + 1
    loads = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    cut = np.flatnonzero((loads * _FACTOR) >> np.uint64(64 - CUT_BITS) == 0)
    owner = np.searchsorted(begin, cut, "right") - 1
    inside = (owner < len(texts)) & (cut + 8 < begin[np.minimum(owner + 1, len(texts))] - 1)
    starts = np.unique(np.concatenate([begin[:-1], cut[inside] + 8]))
    starts = _shortened(starts, np.append(starts[1:], begin[-1]), most)
    ends = np.minimum(np.append(starts[1:], begin[-1]), begin[np.searchsorted(begin, starts, "right")] - 1)
    first, last = np.searchsorted(bound, starts + 1), np.searchsorted(bound, ends) - 1
    real = np.flatnonzero(last > first)
    low, high = bound[first[real]], bound[last[real]]
    long = high - low >= LEAST_CORE
    low, high = low[long], high[long]
    doc = np.searchsorted(begin, low, "right") - 1
    out: list[list[tuple[int, int, bool]]] = [[] for _ in texts]
    at = [0] * len(texts)
    for d, a, z in zip(doc.tolist(), (low - begin[doc]).tolist(), (high - begin[doc]).tolist(), strict=True):
        if a > at[d]:
            out[d].append((at[d], a, False))
        out[d].append((a, z, True))
        at[d] = z
    for d, t in enumerate(texts):
        if at[d] < len(t):
            out[d].append((at[d], len(t), False))
    return out


def digest(core: bytes) -> bytes:
    return hashlib.blake2b(core, digest_size=16).digest()


def summary(encoder: ByteEncoder, packed: bytes) -> tuple[int, str, str]:
    """Number of ids, and SHA-256 of the decimal ids and of the decoded text."""
    ids = encoder.unpack(packed)
    listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return len(ids), listed, hashlib.sha256(encoder.decode(ids)).hexdigest()


def _cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, found = [t.encode() for t in batch["text"]], []
        for a, z in batches_of(texts):
            found += [[digest(t[x:y]) for x, y, core in s if core] for t, s in zip(texts[a:z], segments(texts[a:z]), strict=True)]
        yield pd.DataFrame({"did": batch["did"], "cores": found})


def _encode(path: str, with_ids: bool):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path)
        for batch in batches:
            texts, rows = [t.encode() for t in batch["text"]], []
            for a, z in batches_of(texts):
                for i, s in enumerate(segments(texts[a:z]), a):
                    text, flags = texts[i], batch["flags"].iloc[i]
                    shared = {bytes(f["digest"]): f for f in flags} if flags is not None else {}
                    parts, owned, waits = [], {}, False
                    for x, y, core in s:
                        name = digest(text[x:y]) if core and shared else b""
                        flag = shared.get(name)
                        if flag is not None and not flag["own"]:
                            parts.append(b"\1" + name)
                            waits = True
                            continue
                        if flag is not None and name in owned:
                            ids = owned[name][1]
                        else:
                            ids = encoder.encode(text[x:y].decode())
                        if flag is not None:
                            owned[name] = (name, ids, flag["n"])
                        parts.append(b"\0" + ids)
                    ids = b"" if waits else b"".join([p[1:] for p in parts])
                    done = (None, None, None) if waits else summary(encoder, ids)
                    rows.append((batch["did"].iloc[i], batch["id"].iloc[i], *done, parts if waits else None, list(owned.values()), *([None if waits else ids] if with_ids else [])))
            frame = pd.DataFrame(rows, columns=["did", "id", "n_tokens", "ids_sha256", "decoded_sha256", "parts", "owned", *(["ids"] if with_ids else [])])
            yield frame.astype({"id": batch["id"].dtype, "n_tokens": "Int64"})

    return encode


def _finish(path: str, with_ids: bool):
    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path)
        for batch in batches:
            rows = []
            for doc_id, parts, got in zip(batch["id"], batch["parts"], batch["got"], strict=True):
                known = {bytes(g["digest"]): bytes(g["ids"]) for g in got}
                ids = b"".join([bytes(p[1:]) if p[0] == 0 else known[bytes(p[1:])] for p in parts])
                rows.append((doc_id, *summary(encoder, ids), *([ids] if with_ids else [])))
            frame = pd.DataFrame(rows, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])
            yield frame.astype({"id": batch["id"].dtype})

    return finish


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 (and ids, packed as 16-bit numbers) of every row."""
    path = vocabulary_path or vocabulary("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    name = F.unhex(F.substring(F.sha2(F.concat(F.coalesce(col(id_col).cast("string"), F.lit("-")), F.lit(":"), text), 256), 1, 32))
    rows = docs.select(name.alias("did"), col(id_col).alias("id"), text.alias("text"))

    refs = rows.select("did", "text").mapInPandas(_cores, "did binary, cores array<binary>").select("did", F.explode("cores").alias("digest"))
    refs = save(refs, "core-digests")
    shared = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("owner")).where("n > 1")
    met = join_groups(refs, save(shared, "shared-cores"), "digest", "n", refs.count()).distinct()
    flags = met.groupBy("did").agg(F.collect_list(F.struct("digest", (F.col("owner") == F.col("did")).alias("own"), "n")).alias("flags"))

    fields = f"did binary, id {kind}, {_DONE}, parts array<binary>, owned array<struct<digest: binary, ids: binary, n: long>>" + ", ids binary" * with_ids
    encoded = rows.join(flags, "did", "left").select("did", "id", "text", "flags").mapInPandas(_encode(path, with_ids), fields)
    encoded = save(encoded, "encoded")

    out = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    done = encoded.where("parts IS NULL").select(*out)
    waiting = encoded.where("parts IS NOT NULL").select("did", "id", "parts")
    given = encoded.select(F.inline("owned")).groupBy("digest").agg(F.first("ids").alias("ids"), F.max("n").alias("n"))
    names = F.transform(F.filter("parts", lambda p: F.substring(p, 1, 1) == F.unhex(F.lit("01"))), lambda p: F.substring(p, 2, 16))
    wants = waiting.select("did", F.explode(names).alias("digest")).distinct()
    given = save(given, "core-ids")
    got = join_dealt(wants, given, "digest", "n", refs.count(), "did").groupBy("did").agg(F.collect_list(F.struct("digest", "ids")).alias("got"))
    last = waiting.join(got, "did").select("id", "parts", "got").mapInPandas(_finish(path, with_ids), f"id {kind}, {_DONE}" + ", ids binary" * with_ids)
    return done.unionByName(last)


def op2_chunk_reuse(spark, sf_dir: str) -> DataFrame:
    found = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id")
