"""A keyed table that is merged on read: small writes stay small, merges rewrite only what they must.

Data files are Parquet that Spark writes and nothing changes afterwards. A version is one
small JSON file that names the data files in force; it is created if it does not exist
yet and never replaced, so of two writers one fails and a reader sees a version or
the next one. (The store must refuse to create an existing file: HDFS and local
disks do.)

* A write adds a delta: the rows of the batch, of each key the one that is greatest by
  ``order``. The table itself is not read. A batch known by its number is written once.
* A read takes the newest row of each key. Only keys of the deltas are compared, and
  only with files whose range of keys meets theirs; other files are read as they are. Places of rows that
  lost go to the executors as bitmaps, so no whole row is shuffled.
* A merge folds deltas into the table. Rows that lost are listed as dead beside their file; only
  files with a large dead share, and small files, are rewritten. Rewritten rows are ordered
  by interleaved places of the ``cluster`` columns, so filters on either of them skip row groups.
* Side tables live below the same path and in the same versions, so that a batch and, say, the
  position up to which its source was read come into force together or not at all.
* Vacuum removes versions beyond the last few and the files that none of them names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..paths import file_system, names_in, read_text, stored
from .ordered import saved

#: A merged file is rewritten when this share of its rows is dead, or when it has fewer bytes than SMALL of TARGET.
DEAD, SMALL, TARGET = 0.2, 0.25, 256 << 20
#: Keys of deltas are broadcast up to this number of rows, and so are dead rows.
BROADCAST_ROWS = 200_000
#: A job merges when deltas have this share of the table's rows, or are this many.
SHARE, DELTAS = 0.1, 16
#: Places a column has in the interleaved order, as bits, and rows sampled to find them.
BITS, SAMPLED = 6, 10_000


@dataclass(frozen=True)
class Merged:
    """What a merge did: files and bytes rewritten, left alone, and written."""

    rewritten_files: int
    rewritten_bytes: int
    kept_files: int
    kept_bytes: int
    written_bytes: int


class MergeTable:
    """Rows by ``keys``; of a key the row with the greatest ``order`` counts. Orders begin with "__" unless they are columns of the table."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("id",), order: tuple[str, ...] = ("__batch", "__seq"), cluster: tuple[str, ...] = (), target: int = TARGET, side: str = ""):
        self.spark, self.path, self.keys, self.order, self.cluster, self.target, self.side = spark, path.rstrip("/"), list(keys), list(order), list(cluster), target, side

    # --- versions ---

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/log") if n.endswith(".json"))

    def version(self, n: int | None = None) -> dict:
        versions = self.versions()
        if not versions:
            return {"n": -1, "batch": -1, "schemas": {}, "files": [], "dead": []}
        return json.loads(read_text(self.spark, f"{self.path}/log/{versions[-1] if n is None else n}.json"))

    def _commit(self, before: dict, **changes) -> None:
        after = before | changes | {"n": before["n"] + 1}
        system, target = file_system(self.spark, f"{self.path}/log/{after['n']}.json")
        out = system.create(target, False)  # fails if another writer made this version
        out.write(bytearray(json.dumps(after).encode()))
        out.close()

    # --- reading ---

    def _scan(self, files: list[dict], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema).withColumns({"__file": F.lit(None).cast("string"), "__row": F.lit(None).cast("long")})
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f['file']}" for f in files]).withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})

    def _live(self, files: list[dict], v: dict, schema: StructType) -> DataFrame:
        """Rows of merged files, with their file, but for the dead ones."""
        marred = [f for f in files if f["dead"]]
        whole = self._scan([f for f in files if not f["dead"]], schema)
        if not marred:
            return whole
        dead = self.spark.read.parquet(*[f"{self.path}/dead/{d['name']}" for d in v["dead"] if d["side"] == self.side])
        if sum(f["dead"] for f in marred) <= BROADCAST_ROWS:
            dead = F.broadcast(dead.where(F.col("__file").isin([f["file"].rsplit("/", 1)[1] for f in marred])))
        return whole.unionByName(self._scan(marred, schema).join(dead, ["__file", *self.keys], "left_anti"))

    def _split(self, v: dict) -> tuple[list[dict], list[dict], list[dict]]:
        """Merged files that the deltas can't meet, those that they can, and the deltas."""
        own = [f for f in v["files"] if f["side"] == self.side]
        deltas, merged = [f for f in own if f["delta"]], [f for f in own if not f["delta"]]
        meets = [any(f["low"] <= d["high"] and d["low"] <= f["high"] for d in deltas) for f in merged]
        return [f for f, m in zip(merged, meets, strict=True) if not m], [f for f, m in zip(merged, meets, strict=True) if m], deltas

    def _lost(self, v: dict, schema: StructType) -> DataFrame | None:
        """(__file, __row, __old, keys) of the rows of deltas and of the files they meet that are not the newest of their key; None if there can be none.

        Only keys and orders are read and shuffled. ``__old`` marks rows of merged files.
        """
        _, met, deltas = self._split(v)
        if not met and len({f["file"].split("/")[0] for f in deltas}) <= 1:
            return None  # a delta has each key once
        place = [F.col("__file"), F.col("__row"), *map(F.col, self.keys), *[F.col(c) for c in self.order if c not in self.keys]]
        fresh = self._scan(deltas, schema).select(*place, F.lit(False).alias("__old"))
        names = fresh.select(self.keys).distinct()
        if sum(f["rows"] for f in deltas) <= BROADCAST_ROWS:
            names = F.broadcast(names)
        held = self._live(met, v, schema).select(*place, F.lit(True).alias("__old")).join(names, self.keys, "left_semi")
        newest = Window.partitionBy(self.keys).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        ranked = fresh.unionByName(held).withColumn("__nth", F.row_number().over(newest)).where("__nth > 1")
        return saved(ranked.select("__file", "__row", "__old", *self.keys), "lost")

    def _newest(self, rows: DataFrame, lost: DataFrame | None) -> DataFrame:
        """Rows (with __file and __row) but for those that lost: these go to all executors as bitmaps, one bit a row of a file, so rows stay where they are read."""
        if lost is None:
            return rows
        number = F.col("__row") + 1
        bits = lost.groupBy("__file", F.bitmap_bucket_number(number).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("__bits"))
        marked = rows.withColumn("__bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), ["__file", "__bucket"], "left")
        at = F.bitmap_bit_position(number)
        byte = F.ascii(F.decode(F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
        dead = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), at.bitwiseAND(F.lit(7)).cast("int") + 1)) != 0
        return marked.where(F.col("__bits").isNull() | ~dead).drop("__bucket", "__bits")

    def read(self, n: int | None = None) -> DataFrame:
        """The table as of a version, the newest by default."""
        v = self.version(n)
        if self.side not in v["schemas"]:
            raise FileNotFoundError(f"no table at {self.path}")
        schema = StructType.fromJson(v["schemas"][self.side])
        far, met, deltas = self._split(v)
        rows = self._live(far + met, v, schema)
        if deltas:
            near = self._scan(deltas, schema).unionByName(self._live(met, v, schema))
            won = self._newest(near, self._lost(v, schema)).where("NOT __gone")
            rows = self._live(far, v, schema).unionByName(won)
        return rows.select([f.name for f in schema if not f.name.startswith("__")])

    # --- writing ---

    def _write(self, rows: DataFrame, delta: bool, files: int | None = None) -> list[dict]:
        """Rows as data files; what the versions say of them."""
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/{folder}"
        rows.write.parquet(at)
        key = F.concat_ws("\x00", *[F.col(c).cast("string") for c in self.keys])
        held = self.spark.read.parquet(at)
        told = held.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"))
        return [{"file": f"{folder}/{r['file']}", "bytes": r["bytes"], "rows": r["rows"], "low": r["low"], "high": r["high"], "delta": delta, "dead": 0, "side": self.side} for r in told.collect()]

    def upsert(self, batch: DataFrame, number: int | None = None, gone: Column | None = None) -> bool:
        """Insert or update the rows of a batch; of equal keys the greatest ``seq`` wins. False if the batch was there already.

        ``gone`` marks rows that delete their key. ``number`` rises with each batch of a stream.
        """
        return self.write_together([(self, batch)], number, gone)

    @staticmethod
    def write_together(parts: list[tuple[MergeTable, DataFrame]], number: int | None = None, gone: Column | None = None, whole: list[int] | None = None) -> bool:
        """Batches for a table and for side tables below the same path, in one version: all of them or none.

        ``whole`` says how many rows each batch must have come to; if it is otherwise,
        nothing counts. False if the batch was there already.
        """
        first = parts[0][0]
        v = first.version()
        if number is not None and number <= v["batch"]:
            return False
        schemas, files, rows = dict(v["schemas"]), list(v["files"]), []
        for table, batch in parts:
            schemas[table.side], written = table._delta(batch, v, gone)
            files += written
            rows.append(sum(f["rows"] for f in written))
        if whole is not None and whole != rows:
            raise ValueError(f"{rows} rows were stored, not {whole}")
        first._commit(v, schemas=schemas, files=files, batch=v["batch"] if number is None else number)
        return True

    def _delta(self, batch: DataFrame, v: dict, gone: Column | None) -> tuple[dict, list[dict]]:
        """The schema, and the files that hold the greatest row of each key of a batch."""
        told = {"__batch": F.lit(v["n"] + 1).cast("long"), "__seq": F.col("seq").cast("long") if "seq" in batch.columns else F.lit(0).cast("long"), "__gone": F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))}
        rows = batch.withColumns(told)
        rows = rows.drop(*[c for c in ("seq",) if c in batch.columns and c not in self.order])
        schema = v["schemas"].get(self.side) or json.loads(rows.schema.json())
        files = self._write(rows.select([f.name for f in StructType.fromJson(schema)]), True)
        return schema, self._once(files, StructType.fromJson(schema))

    def _once(self, files: list[dict], schema: StructType) -> list[dict]:
        """The files of a batch, written again without repeated keys if it has any. Only keys and orders are shuffled to see that."""
        held = self._scan(files, schema)
        if held.groupBy(self.keys).count().where("count > 1").isEmpty():
            return files
        newest = Window.partitionBy(self.keys).orderBy(*[F.col(c).desc_nulls_last() for c in self.order])
        lost = saved(held.withColumn("__nth", F.row_number().over(newest)).where("__nth > 1").select("__file", "__row"), "lost")
        again = self._write(self._newest(held, lost).drop("__file", "__row"), True)
        for folder in {f["file"].split("/")[0] for f in files}:
            system, at = file_system(self.spark, f"{self.path}/data/{folder}")
            system.delete(at, True)
        return again

    def delete(self, keys: DataFrame) -> bool:
        """Delete the rows with these keys."""
        v = self.version()
        fields = StructType.fromJson(v["schemas"][self.side])
        rows = keys.select(*self.keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields if f.name not in self.keys and not f.name.startswith("__")])
        return self.upsert(rows, gone=F.lit(True))

    # --- upkeep ---

    def due(self) -> bool:
        """Whether deltas have grown so much that a merge pays."""
        v = self.version()
        own = [f for f in v["files"] if f["side"] == self.side]
        deltas = [f for f in own if f["delta"]]
        merged = sum(f["rows"] for f in own if not f["delta"])
        return len({f["file"].split("/")[0] for f in deltas}) > DELTAS or sum(f["rows"] for f in deltas) > SHARE * merged

    def merge(self) -> Merged:
        """Fold the deltas in and combine small files; all other files stay as they are."""
        v = self.version()
        if self.side not in v["schemas"]:
            return Merged(0, 0, 0, 0, 0)
        schema = StructType.fromJson(v["schemas"][self.side])
        far, met, deltas = self._split(v)
        name = lambda f: f["file"].rsplit("/", 1)[1]
        lost, rows, counts = None, None, {}
        if deltas:
            lost = self._lost(v, schema)
            rows = self._newest(self._scan(deltas, schema), lost).where("NOT __gone").drop("__file", "__row")
            if lost is not None:
                counts = {r["__file"]: r["count"] for r in lost.where("__old").groupBy("__file").count().collect()}  # one row a file
        merged = [f | {"dead": f["dead"] + counts.get(name(f), 0)} for f in far + met]
        small = [f for f in merged if f["bytes"] < SMALL * self.target]
        stale = [f for f in merged if f["dead"] >= DEAD * f["rows"] and f["dead"]]
        again = {name(f) for f in stale + (small if len(small) > 1 or deltas else [])}
        if not deltas and not again:
            return Merged(0, 0, len(merged), sum(f["bytes"] for f in merged), 0)
        old = [f for f in far + met if name(f) in again]
        if old:
            left = self._newest(self._live(old, v, schema), lost).drop("__file", "__row")
            rows = left if rows is None else rows.unionByName(left)
        amount = sum(f["bytes"] for f in old) + sum(f["bytes"] for f in deltas)
        written = self._write(self._clustered(rows, max(1, -(-amount // self.target))), False)
        kept = [f for f in merged if name(f) not in again]
        beside = [f for f in v["files"] if f["side"] != self.side]
        dead, others = [d for d in v["dead"] if d["side"] == self.side], [d for d in v["dead"] if d["side"] != self.side]
        if lost is not None and any(counts.get(name(f)) for f in kept):
            dead.append({"name": uuid.uuid4().hex, "side": self.side})
            lost.where(F.col("__old") & ~F.col("__file").isin(sorted(again))).select("__file", *self.keys).write.parquet(f"{self.path}/dead/{dead[-1]['name']}")
        if not any(f["dead"] for f in kept):
            dead = []
        self._commit(v, files=beside + kept + written, dead=others + dead)
        return Merged(len(old), sum(f["bytes"] for f in old), len(kept), sum(f["bytes"] for f in kept), sum(f["bytes"] for f in written))

    def _clustered(self, rows: DataFrame, files: int) -> DataFrame:
        """Rows dealt to files in the interleaved order of the cluster columns, or in the order of the keys."""
        if not self.cluster:
            return rows.repartitionByRange(files, *self.keys).sortWithinPartitions(*self.keys)
        sample = rows.select(self.cluster).orderBy(F.xxhash64(*self.keys, *self.cluster)).limit(SAMPLED).collect()
        places = []
        for c in self.cluster:
            seen = sorted(r[c] for r in sample if r[c] is not None)
            cuts = sorted({seen[len(seen) * i // (1 << BITS)] for i in range(1, 1 << BITS)}) if seen else []
            kind = rows.schema[c].dataType
            known = F.array(*[F.lit(x).cast(kind) for x in cuts]) if cuts else F.array().cast(f"array<{kind.simpleString()}>")
            value = F.col(c)
            places.append(F.size(F.filter(known, lambda x: x <= value)))
        bits = [F.shiftleft(F.shiftright(p, b).bitwiseAND(F.lit(1)), b * len(places) + i) for b in range(BITS) for i, p in enumerate(places)]
        ordered = rows.withColumn("__z", reduce(lambda a, b: a.bitwiseOR(b), bits))
        return ordered.repartitionByRange(files, "__z", *self.cluster).sortWithinPartitions("__z", *self.cluster).drop("__z")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove versions beyond the last ``keep`` and whatever none of these names; the names of what went."""
        versions, went = self.versions(), []
        held = [self.version(n) for n in versions[-keep:]]
        files = {f["file"] for v in held for f in v["files"]}
        dead = {d["name"] for v in held for d in v["dead"]}
        for n in versions[:-keep]:
            went.append(f"log/{n}.json")
        for folder in names_in(self.spark, f"{self.path}/data"):
            own = [n for n in names_in(self.spark, f"{self.path}/data/{folder}") if n.endswith(".parquet")]
            gone = [n for n in own if f"{folder}/{n}" not in files]
            went += [f"data/{folder}"] if len(gone) == len(own) else [f"data/{folder}/{n}" for n in gone]
        if stored(self.spark, f"{self.path}/dead"):
            went += [f"dead/{d}" for d in names_in(self.spark, f"{self.path}/dead") if d not in dead]
        for name in went:
            system, at = file_system(self.spark, f"{self.path}/{name}")
            system.delete(at, True)
        return went
