"""A stored inverted index in segments, whose blocks tell how much they can score.

New chunks become a segment of their own; nothing that is there is read or written again.
When several segments have about the same size they are merged into one, so a table
that grows in N batches has about log N segments, and each posting is rewritten as often.

A segment deals its chunks to document blocks of chunks of similar length. A posting
row holds what one token has in one document block, with the greatest frequency and the least
length in it. Whole blocks share a file, whose rows are in order of token: posting rows are
written where they are made, and a file names its own chunks only, so its ids stay a small
dictionary however many chunks there are. These two bound the token's share of any BM25 score in the block,
whatever the statistics are by then. A question over many postings scores
the most promising blocks first and then only blocks that may still reach the k-th best score.

Chunks that are indexed again replace their older postings: the newer segment lists them.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import tokens
from ..paths import file_system, names_in, read_text

#: Columns that filters may name, kept beside the length of a chunk.
FILTERED = ("project_path", "project_name", "chunk_type", "file_path", "operation", "session_id", "timestamp")
#: Chunks in a document block, and length classes to a factor of e.
BLOCK, CLASSES = 128, 8
#: Segments of one size class that are merged, and the factor between size classes.
ALIKE = 4
#: Questions with more postings than this score blocks by their bounds, FIRST of them to begin with.
DIRECT, FIRST = 2_000_000, 64
#: Words in a task that makes posting rows, which is a file: whole document blocks are dealt to tasks. Small segments have tasks of FEW_WORDS, so that all cores have some.
WORDS_A_TASK, FEW_WORDS = 2_000_000, 250_000
#: Block lists and lists of replaced chunks up to this number of rows are broadcast.
BROADCAST_ROWS = 200_000


#: Given with every read: a question doesn't wait for Spark to look at files for their columns.
_POSTINGS = "token string, block long, entries array<struct<id: string, tf: int, n: int>>, most int, least int, size long"


#: Posting rows as tasks make them; entries are three lists until they are written.
_MADE = "token string, block long, ids array<string>, tfs array<int>, ns array<int>, most int, least int, size long"


def _rows_of(block: int, tokens: pa.Array, docs: np.ndarray, tf: np.ndarray | None, ids: pa.Array, n: np.ndarray) -> pa.Table:
    """Posting rows of one document block, from its tokens (each with the number of its document, and how often it is there if it is not once)."""
    words = tokens.dictionary_encode()
    # documents by id, so that entries are in order of id
    order = np.array(pa.compute.sort_indices(ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids, n = ids.take(pa.array(order)), n[order].astype(np.int32)
    pair = np.asarray(words.indices).astype(np.int64) * len(order) + place[docs]
    met, at = np.unique(pair, return_inverse=True)
    tf = np.bincount(at, tf, len(met)).astype(np.int32)
    word, doc = np.divmod(met, max(len(order), 1))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    ends = pa.array(np.append(first, len(word)), pa.int32())
    size = np.diff(np.append(first, len(word)))
    listed = lambda values: pa.ListArray.from_arrays(ends, values)
    most, least = (f(v, first) if len(first) else np.zeros(0, np.int32) for f, v in ((np.maximum.reduceat, tf), (np.minimum.reduceat, n[doc])))
    columns = [words.dictionary, pa.array(np.full(len(first), block), pa.int64()), listed(ids.take(pa.array(doc))), listed(pa.array(tf)), listed(pa.array(n[doc])), pa.array(most, pa.int32()), pa.array(least, pa.int32()), pa.array(size, pa.int64())]
    return pa.table(columns, [f.split(" ")[0] for f in _MADE.split(", ")])


def _of_chunks(group: pa.Table) -> pa.Table:
    """Posting rows of one block of chunks (block, id, w)."""
    one = group.combine_chunks()
    w, ids = one.column("w").combine_chunks(), one.column("id").combine_chunks()
    sizes = np.diff(np.asarray(w.offsets))
    return _rows_of(one.column("block")[0].as_py(), w.flatten(), np.repeat(np.arange(len(sizes)), sizes), None, ids, sizes)


def _of_uses(group: pa.Table) -> pa.Table:
    """Posting rows of one block of uses (block, id, n, token, tf)."""
    one = group.combine_chunks()
    ids = one.column("id").combine_chunks().dictionary_encode()
    docs = np.asarray(ids.indices).astype(np.int64)
    n = np.zeros(len(ids.dictionary), np.int32)
    n[docs] = np.asarray(one.column("n"))
    return _rows_of(one.column("block")[0].as_py(), one.column("token").combine_chunks(), docs, np.asarray(one.column("tf"), np.float64), ids.dictionary, n)


def share(idf: str, tf: str, n: str, mean: float) -> str:
    """What a token contributes to BM25, as SQL: it rises with tf and falls with n."""
    k, b = fixed.BM25_K1, fixed.BM25_B
    return f"{idf} * {tf} * {k + 1!r}D / ({tf} + {k!r}D * ({1 - b!r}D + {b!r}D * {n} / {float(mean)!r}D))"


@dataclass
class TextIndex:
    """Segments below a folder; the newest version lists those in force."""

    spark: SparkSession
    path: str
    block: int = BLOCK
    direct: int = DIRECT

    # --- versions ---

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/log") if n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self._versions())

    def segments(self) -> list[dict]:
        """The segments in force, oldest first: name, docs, words, replaced."""
        versions = self._versions()
        return json.loads(read_text(self.spark, f"{self.path}/log/{versions[-1]}.json")) if versions else []

    def _commit(self, segments: list[dict]) -> None:
        system, target = file_system(self.spark, f"{self.path}/log/{max(self._versions(), default=-1) + 1}.json")
        out = system.create(target, False)  # fails if another writer was faster
        out.write(bytearray(json.dumps(segments).encode()))
        out.close()

    # --- writing ---

    def build(self, chunks: DataFrame) -> TextIndex:
        """An index of these chunks alone."""
        self._commit([self._segment(chunks, [])])
        return self

    def add(self, chunks: DataFrame) -> TextIndex:
        """A segment for new or changed chunks; then segments of one size are merged."""
        held = self.segments()
        self._commit([*held, self._segment(chunks, held)])
        while self._merged():
            pass
        return self

    def remove(self, ids: DataFrame) -> TextIndex:
        """Chunks with these ids are found no more; their postings go when segments merge."""
        at, held = f"{self.path}/{uuid.uuid4().hex}", self.segments()
        self.lengths().select("id").join(ids.select("id").distinct(), "id", "left_semi").write.parquet(f"{at}/replaced")
        n = self.spark.read.parquet(f"{at}/replaced").count()
        self._commit([*held, {"name": at.rsplit("/", 1)[1], "docs": 0, "words": 0, "replaced": n}])
        while self._merged():
            pass
        return self

    def _segment(self, chunks: DataFrame, held: list[dict]) -> dict:
        at = f"{self.path}/{uuid.uuid4().hex}"
        kept = [c for c in FILTERED if c in chunks.columns]
        words = chunks.select(F.col("id").cast("string").alias("id"), "content", *kept)
        count = F.size(tokens(F.col("content")))
        words.select("id", count.alias("n"), *kept).write.option("compression", "zstd").parquet(f"{at}/lengths")
        replaced = 0
        if held:
            own = self.spark.read.parquet(f"{at}/lengths").select("id")
            reduce(DataFrame.unionByName, [self._lengths_of(s).select("id") for s in held if s["docs"]]).join(own, "id", "left_semi").distinct().write.parquet(f"{at}/replaced")
            replaced = self.spark.read.parquet(f"{at}/replaced").count()
        return self._postings(at, words.select("id", "content"), count) | {"replaced": replaced}

    def _postings(self, at: str, given: DataFrame, n: Column, whole: bool = True) -> dict:
        """Write the posting rows of chunks (id, content), or of uses (id, n, token, tf); the lengths are there already.

        The rows are dealt by document block, texts as they are. All of a block is in one
        task then, which counts its tokens, makes its posting rows and writes them, in order of token.
        """
        lengths = self.spark.read.parquet(f"{at}/lengths")
        kind = lambda n: F.floor(F.log1p(n.cast("double")) * CLASSES).cast("int")
        told = lengths.groupBy(kind(F.col("n")).alias("k")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).collect()  # some hundred classes at most
        parts = {r["k"]: max(1, math.ceil(r["docs"] / self.block)) for r in told}
        words = sum(r["words"] or 0 for r in told)
        tasks = max(1, min(self.spark.sparkContext.defaultParallelism, words // FEW_WORDS), words // WORDS_A_TASK)
        many = F.coalesce(F.create_map(*[F.lit(x) for k, p in parts.items() for x in (k, p)])[kind(n)], F.lit(1)) if parts else F.lit(1)
        block = kind(n).cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), many)
        dealt = given.withColumn("block", block).where("block IS NOT NULL").repartition(tasks, "block")
        if whole:
            made = dealt.select("block", "id", tokens(F.col("content")).alias("w")).groupBy("block").applyInArrow(_of_chunks, _MADE)
        else:
            made = dealt.select("block", "id", "n", "token", "tf").groupBy("block").applyInArrow(_of_uses, _MADE)
        entries = F.transform(F.arrays_zip("ids", "tfs", "ns"), lambda e: F.struct(e["ids"].alias("id"), e["tfs"].alias("tf"), e["ns"].alias("n")))
        rows = made.sortWithinPartitions("token", "block").select("token", "block", entries.alias("entries"), "most", "least", "size")
        rows.write.option("compression", "zstd").parquet(f"{at}/postings")
        return {"name": at.rsplit("/", 1)[1], "docs": sum(r["docs"] for r in told), "words": words}

    def _merged(self) -> bool:
        """Merge the ALIKE segments of one size class, if there are as many; neighbours only, so that newer ones stay newer."""
        held = self.segments()
        size = [int(math.log(max(s["docs"], 1), ALIKE)) for s in held]
        for a in range(len(held) - ALIKE + 1):
            if len(set(size[a : a + ALIKE])) == 1 and any(s["docs"] for s in held[a : a + ALIKE]):
                break
        else:
            return False
        old, newer = held[a : a + ALIKE], held[a + ALIKE :]
        at = f"{self.path}/{uuid.uuid4().hex}"
        reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [self._lengths_of(s, held) for s in old if s["docs"]]).write.option("compression", "zstd").parquet(f"{at}/lengths")
        uses = reduce(DataFrame.unionByName, [self._entries(self._segment_rows(s), s, held) for s in old if s["docs"]]).select("id", "n", "token", "tf")
        joined = self._postings(at, uses, F.col("n"), False)
        gone = [self.spark.read.parquet(f"{self.path}/{s['name']}/replaced") for s in old if s["replaced"]]
        joined["replaced"] = 0
        if gone and a:  # segments before these still hold what they replaced
            reduce(DataFrame.unionByName, gone).distinct().write.parquet(f"{at}/replaced")
            joined["replaced"] = self.spark.read.parquet(f"{at}/replaced").count()
        self._commit([*held[:a], joined, *newer])
        return True

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove versions beyond the last ``keep`` and segments that none of them lists."""
        versions = self._versions()
        named = {s["name"] for n in versions[-keep:] for s in json.loads(read_text(self.spark, f"{self.path}/log/{n}.json"))}
        went = [f"log/{n}.json" for n in versions[:-keep]] + [n for n in names_in(self.spark, self.path) if n != "log" and n not in named]
        for name in went:
            system, at = file_system(self.spark, f"{self.path}/{name}")
            system.delete(at, True)
        return went

    # --- reading ---

    def _gone(self, segment: dict, held: list[dict]) -> list[DataFrame]:
        """Ids that segments after this one have replaced."""
        later = held[[s["name"] for s in held].index(segment["name"]) + 1 :]
        out = []
        for s in later:
            if s["replaced"]:
                ids = self.spark.read.parquet(f"{self.path}/{s['name']}/replaced")
                out.append(F.broadcast(ids) if s["replaced"] <= BROADCAST_ROWS else ids)
        return out

    def _live(self, rows: DataFrame, segment: dict, held: list[dict] | None) -> DataFrame:
        return reduce(lambda r, ids: r.join(ids, "id", "left_anti"), self._gone(segment, held or []), rows)

    def _lengths_of(self, segment: dict, held: list[dict] | None = None) -> DataFrame:
        return self._live(self.spark.read.parquet(f"{self.path}/{segment['name']}/lengths"), segment, held) if held else self.spark.read.parquet(f"{self.path}/{segment['name']}/lengths")

    def lengths(self) -> DataFrame:
        """Length and filter columns of every chunk."""
        held = self.segments()
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [self._lengths_of(s, held) for s in held if s["docs"]])

    def _segment_rows(self, segment: dict, terms: list[str] | None = None) -> DataFrame:
        """Posting rows of a segment; of each file only the pages of ``terms`` are read."""
        rows = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/{segment['name']}/postings")
        if terms is not None:
            rows = rows.where(F.col("token").isin(terms))
        return rows.withColumn("segment", F.lit(segment["name"]))

    def _entries(self, rows: DataFrame, segment: dict, held: list[dict]) -> DataFrame:
        """(segment, block, token, id, tf, n) of posting rows, but for replaced chunks."""
        return self._live(rows.selectExpr("segment", "block", "token", "inline(entries)"), segment, held)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(token, id, tf, n) of all tokens, or of these."""
        held = self.segments()
        return reduce(DataFrame.unionByName, [self._entries(self._segment_rows(s, terms), s, held) for s in held if s["docs"]]).select("token", "id", "tf", "n")

    def counted(self, terms: list[str], condition: Column) -> tuple[DataFrame, DataFrame]:
        """id, n and tf0.. of every chunk with a term; one row of docs, mean and df0.., among the chunks that meet the condition."""
        allowed = self.lengths().where(condition)
        hits = self.postings(terms).join(allowed.select("id"), "id", "left_semi")
        found = hits.groupBy("id", "n").agg(*[F.coalesce(F.sum(F.when(F.col("token") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)])
        used = hits.agg(*[F.count_if(F.col("token") == t).alias(f"df{i}") for i, t in enumerate(terms)])
        return found, allowed.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean")).join(F.broadcast(used))  # one row each

    # --- ranking ---

    def _statistics(self, terms: list[str], held: list[dict]) -> tuple[int, float, dict[str, int], int]:
        """Chunks, mean length, chunks with each term, and postings of all terms."""
        if any(s["replaced"] for s in held):
            docs = self.lengths().agg(F.count(F.lit(1)), F.sum("n")).first()
            counts = self.postings(terms).groupBy("token").count().collect()
        else:
            docs = (sum(s["docs"] for s in held), sum(s["words"] for s in held))
            counts = reduce(DataFrame.unionByName, [self._segment_rows(s, terms).select("token", "size") for s in held if s["docs"]]).groupBy("token").agg(F.sum("size")).collect()
        df = {t: n for t, n in counts}
        return docs[0], (docs[1] or 0) / max(docs[0], 1), df, sum(df.values())

    def best(self, terms: list[str], k: int) -> DataFrame:
        """(id, relevance): the ``k`` best chunks by BM25 over the whole table, ties by id."""
        held = self.segments()
        if not any(s["docs"] for s in held):
            return self.spark.createDataFrame([], "id string, relevance double")
        docs, mean, df, postings = self._statistics(terms, held)
        idf = {t: math.log(1 + (docs - df[t] + 0.5) / (df[t] + 0.5)) for t in sorted(df)}
        if not idf:
            return self.spark.createDataFrame([], "id string, relevance double")
        if postings <= self.direct:
            return self._scored(self.postings(sorted(idf)), idf, mean).orderBy(F.desc("relevance"), "id").limit(k)
        return self._by_blocks(idf, mean, held, k)[0]

    def _scored(self, entries: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
        """BM25 of each chunk, its terms added in their order."""
        tf = entries.groupBy("id", "n").agg(*[F.expr(f"coalesce(sum(if(token = '{t}', tf, NULL)), 0) AS tf{i}") for i, t in enumerate(idf)])  # terms are word characters
        total = " + ".join(["0D", *[share(f"{v!r}D", f"tf{i}", "n", mean) for i, v in enumerate(idf.values())]])
        return tf.selectExpr("id", f"round({total}, 9) AS relevance")

    def _by_blocks(self, idf: dict[str, float], mean: float, held: list[dict], k: int) -> tuple[DataFrame, int, int]:
        """The best chunks, and how many of how many document blocks were scored for them."""
        terms, with_docs = list(idf), [s for s in held if s["docs"]]
        weight = "CASE token " + " ".join(f"WHEN '{t}' THEN {v!r}D" for t, v in idf.items()) + " END"
        heads = reduce(DataFrame.unionByName, [self._segment_rows(s, terms).select("segment", "block", "token", "most", "least") for s in with_docs])
        bounds = heads.groupBy("segment", "block").agg(F.expr(f"sum({share(weight, 'most', 'least', mean)}) AS bound"))
        first = [(r["segment"], r["block"]) for r in bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST).select("segment", "block").collect()]

        def scored(blocks: list[tuple] | None, wanted: DataFrame | None) -> DataFrame:
            out = []
            for s in with_docs:
                rows = self._segment_rows(s, terms)
                if blocks is not None:
                    own = [b for name, b in blocks if name == s["name"]]
                    rows = rows.where(F.col("block").isin(own)) if own else rows.limit(0)
                else:
                    rows = rows.join(wanted, ["segment", "block"], "left_semi")
                out.append(self._entries(rows, s, held))
            return self._scored(reduce(DataFrame.unionByName, out), idf, mean).orderBy(F.desc("relevance"), "id").limit(k)

        held_best = scored(first, None).collect()  # k rows
        reached = held_best[-1]["relevance"] - 1e-8 if len(held_best) == k else -1.0
        open_ = bounds.where(F.col("bound") >= reached).select("segment", "block")
        some = open_.limit(FIRST * FIRST + 1).collect()
        all_blocks = bounds.count()
        if len(some) <= FIRST * FIRST:  # few: literals that skip row groups
            return scored([tuple(r) for r in some], None), len(some), all_blocks
        n = open_.count()
        return scored(None, F.broadcast(open_) if n <= BROADCAST_ROWS else open_), n, all_blocks
