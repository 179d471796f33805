"""Exact deduplication with a log-structured merge index (DataFrame operations only).

Every text becomes a digest. A batch of rows is cut into memtables of bounded size
(sets of input splits); each is flushed as a sorted run: one row per digest, with
the identifier that wins (smallest or largest) and the number of rows, and beside it a
filter, a table of 32-bit fingerprints of the digests. When a level holds
``fanout`` runs, the oldest ``fanout`` of them are compacted into one run of the
next level, keeping the winning identifier of each digest; all other runs stay as
they are. A manifest lists the runs, so an index outlives its session and takes
further batches.

Look-up reads the filters first: a fingerprint that only one run has belongs to
digests that no other run holds, so those runs' entries need not be merged. Only
entries under a fingerprint of two runs or more, or with two rows or more, are read
and merged. Digests that have two rows or more are hits and are verified byte by
byte: the smallest and the largest text of a digest must be the same. Digests that
fail (collisions; they can be forced with a short ``digest_bytes``) are indexed
again under the text itself, so the outcome is exact for any digest.

Skew: a digest is pre-aggregated in each task before every shuffle, and the
look-up broadcasts the bounded set of hot digests (as ``join_groups`` does).

Defined results: a null text counts as the empty text. A null id never wins
against another id; groups of null ids only have a null ``keep_id``. Of repeated
rows (same id, same text) exactly one is kept. An empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import HOT_GROUPS, HOT_LEAST, col, discard, names_in, remove, save, shared_dir, text_or_empty

#: Up to so many verified digests are sent to the scan; beyond it they are joined by shuffle.
BROADCAST_HITS = 200_000
#: A batch becomes at most MEMTABLES memtables; of a large batch each holds more rows.
MEMTABLE_ROWS, MEMTABLES, FANOUT = 1 << 16, 64, 8
_MANIFEST = "version long, level int, path string, filter string"


def _best(keep: str):
    """Aggregate of (present, id, row): the winning row of a group."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    return F.max if keep == "largest" else F.min


def _entry(keep: str) -> Column:
    present = F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()
    return F.struct(present.alias("p"), F.col("id"), F.col("rid"))


@dataclass(frozen=True)
class Run:
    level: int
    path: str
    filter: str


class MergeIndex:
    """Runs (key, keep, n) by level below ``path``; an existing index there is taken up."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS, memtables: int = MEMTABLES, fanout: int = FANOUT):
        self.spark, self.keep, self.best = spark, keep, _best(keep)
        self.path = path or f"{shared_dir(spark)}/merge-index-{uuid.uuid4().hex}"
        self.memtable_rows, self.memtables, self.fanout = memtable_rows, memtables, fanout
        versions = [int(n.removeprefix("manifest-")) for n in names_in(spark, self.path) if n.startswith("manifest-")]
        self.version = max(versions, default=-1)
        found = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest-{self.version}").orderBy("level", "path").collect() if versions else []
        self.runs = [Run(r["level"], r["path"], r["filter"]) for r in found if r["path"]]

    def add(self, rows: DataFrame) -> None:
        """Flush a batch (rid, id, key) and compact the levels that have become full."""
        total = rows.count()
        if not total:
            return
        tables = min(self.memtables, -(-total // self.memtable_rows))
        run = F.pmod(F.shiftright("rid", 33), F.lit(tables)).cast("int")  # rid holds the number of its input split above
        self._write(rows.groupBy(run.alias("run"), "key").agg(self.best(_entry(self.keep)).alias("keep"), F.count(F.lit(1)).alias("n")), 0)
        level = 0
        while level <= max(r.level for r in self.runs):
            self._compact(level)
            level += 1
        self._publish()

    def _compact(self, level: int) -> None:
        """Merge every full set of ``fanout`` runs of a level, all of them in one job."""
        old = [r for r in self.runs if r.level == level]
        full = old[: len(old) // self.fanout * self.fanout]
        if full:
            held = reduce(DataFrame.unionAll, [self._entries(r).withColumn("run", F.lit(i // self.fanout)) for i, r in enumerate(full)])
            self._write(held.groupBy("run", "key").agg(self.best("keep").alias("keep"), F.sum("n").alias("n")), level + 1)
            self.runs = [r for r in self.runs if r not in full]
            for r in full:
                remove(self.spark, r.path)
                remove(self.spark, r.filter)

    def _write(self, merged: DataFrame, level: int) -> None:
        """Sorted runs and their filters; rows hold run, key, keep, n."""
        table = f"{self.path}/l{level}-{self.version + 1:06d}-{uuid.uuid4().hex[:8]}"
        merged.select("key", "keep", "n", "run").sortWithinPartitions("run", "key").write.partitionBy("run").option("compression", "zstd").parquet(table)
        self.schema = merged.select("key", "keep", "n").schema
        held = self.spark.read.parquet(table)
        held.select("run", _fingerprint(F.col("key")).alias("print"), (F.col("n") > 1).alias("many")).write.partitionBy("run").option("compression", "zstd").parquet(f"{table}-filter")
        self.runs += [Run(level, f"{table}/{n}", f"{table}-filter/{n}") for n in sorted(names_in(self.spark, table), key=lambda n: (len(n), n)) if n.startswith("run=")]

    def _publish(self) -> None:
        """The manifest of a version is written once, after its runs."""
        self.version += 1
        table = ", ".join(f"({self.version}L, {r.level}, '{r.path}', '{r.filter}')" for r in self.runs)
        self.spark.sql(f"SELECT * FROM VALUES {table} AS t(version, level, path, filter)").coalesce(1).write.parquet(f"{self.path}/manifest-{self.version}")
        remove(self.spark, f"{self.path}/manifest-{self.version - 1}")

    def _entries(self, run: Run) -> DataFrame:
        read = self.spark.read
        return (read.schema(self.schema) if hasattr(self, "schema") else read).parquet(run.path).select("key", "keep", "n")

    def repeated(self) -> DataFrame | None:
        """key, keep, n of every digest with two rows or more; None for an empty index."""
        if not self.runs:
            return None
        entries = reduce(DataFrame.unionAll, [self._entries(r) for r in self.runs])
        if len(self.runs) > 1:
            filters = reduce(DataFrame.unionAll, [self.spark.read.schema("print int, many boolean").parquet(r.filter) for r in self.runs])
            wanted = filters.groupBy("print").agg(F.count(F.lit(1)).alias("c"), F.bool_or("many").alias("many")).where("c > 1 OR many").select("print")
            wanted = save(wanted, "contested")
            few = wanted.count() <= BROADCAST_HITS
            entries = entries.withColumn("print", _fingerprint(F.col("key"))).join(F.broadcast(wanted) if few else wanted, "print", "left_semi").drop("print")
        return entries.groupBy("key").agg(self.best("keep").alias("keep"), F.sum("n").alias("n")).where("n > 1")

    def drop(self) -> None:
        remove(self.spark, self.path)


def _fingerprint(key: Column) -> Column:
    return F.shiftright(F.xxhash64(key), 32).cast("int")


def _look_up(rows: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """Every row with its group; rows without a hit are groups of their own."""
    limit = max(HOT_LEAST, total // HOT_GROUPS)
    hot, cold = hits.where(F.col("n") > limit), hits.where(F.col("n") <= limit)
    warm = rows.join(F.broadcast(hot), "key", "inner")  # at most HOT_GROUPS digests
    rest = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key", "left")
    alone = F.col("n").isNull()
    return warm.unionByName(rest).select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("rid") == F.col("keep.rid"))).alias("kept"), "sha",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT, digest_bytes: int = 32) -> DataFrame:
    """A row for every row of ``docs``: id, keep_id, group_size, kept, sha (SHA-256, binary)."""
    read = docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    hashed = F.unhex(F.sha2("text", 256))
    rows = save(read.select(F.monotonically_increasing_id().alias("rid"), "id", hashed.alias("sha")), "digests")
    rows = rows.withColumn("key", F.substring("sha", 1, digest_bytes) if digest_bytes < 32 else F.col("sha"))
    total = rows.count()

    def hits_of(part: DataFrame) -> DataFrame | None:
        index = MergeIndex(docs.sparkSession, None, keep, memtable_rows, MEMTABLES, fanout)
        index.add(part)
        found = index.repeated()
        found = None if found is None else save(found, "hits")
        index.drop()
        return found

    hits = hits_of(rows)
    if hits is None:
        return rows.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    few = hits.count() <= BROADCAST_HITS
    texts = read.select("id", "text", hashed.alias("sha")).withColumn("key", F.substring("sha", 1, digest_bytes))
    wanted = hits.select("key")
    compared = texts.join(F.broadcast(wanted) if few else wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("a"), F.max("text").alias("z"))
    collided = save(compared.where("a != z").select("key"), "collided")
    if collided.isEmpty():
        return _look_up(rows, hits, total)
    again = texts.join(collided, "key", "left_semi").select(F.monotonically_increasing_id().alias("rid"), "id", "sha", F.encode("text", "utf-8").alias("key"))
    again = save(again, "collided-rows")
    exact = _look_up(again, hits_of(again), total)
    return _look_up(rows.join(collided, "key", "left_anti"), hits.join(collided, "key", "left_anti"), total).unionByName(exact)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
