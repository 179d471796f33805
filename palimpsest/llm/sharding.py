"""K-d tree sharding by bytes (DataFrame operations only).

A node that must hold s shards is cut at the weighted median (the point with
floor(s/2)/s of its bytes before it) of its widest metadata dimension, until
every leaf is one shard of about the target bytes. All nodes of a level are cut
together: coordinates are integers of 24 bits, followed by 36 bits of a row hash
that separates ties, so a value that a third of all rows share is cut inside. A
cut is found by refining histograms: each pass sums bytes by (node, next bits),
which combines in the tasks, and brings at most ``HISTOGRAM`` sums to the driver
whatever the number of rows. No row moves until the slots are numbered.

Dimensions are strings (placed by their hash, so equal values stay together)
or numbers (log-scaled between the table's minimum and maximum). The extent of a
node along a dimension is the difference of its largest and smallest coordinate; ties
take the first dimension named.

Defined results: a null text has no bytes and counts 1; a null coordinate is the
smallest; repeated rows share all cuts but have their own slots; with fewer
rows than shards some shards stay empty; an empty table gives no rows. Equal
texts may be dealt to different shards: the law is `bytes`. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import col, save, text_or_empty

COORDINATE_BITS, TIE_BITS = 24, 36
#: Most histogram sums that one pass brings to the driver.
HISTOGRAM = 1 << 15
#: A cut is fine enough when the bytes in doubt are at most this part of the target.
TOLERANCE = 2e-4
#: Rows that one task numbers.
SLOT_ROWS = 1 << 16


@dataclass
class Node:
    shards: int
    first: int  # its first shard
    dim: int = 0
    cut: int = 0  # keys below it go left


def _position(name: str, kind: T.DataType, low: float, high: float) -> Column:
    """0 to 2^24 - 1 along a dimension; null is 0."""
    most = (1 << COORDINATE_BITS) - 1
    if isinstance(kind, T.NumericType):
        c = col(name).cast("double")
        span = F.log1p(F.lit(high - low)) if high > low else F.lit(1.0)
        place = F.floor(F.log1p(F.greatest(c - F.lit(low), F.lit(0.0))) / span * F.lit(most)).cast("long")
        return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(most)), F.lit(0)).cast("long")
    placed = F.shiftrightunsigned(F.xxhash64(col(name).cast("string")), 64 - COORDINATE_BITS)
    return F.when(col(name).isNull(), F.lit(0)).otherwise(placed).cast("long")


def _narrow(docs: DataFrame, id_col: str, text_col: str, dims: list[str]) -> DataFrame:
    """id, size, crc and the key along each dimension, written once."""
    kinds = {d: docs.schema[d].dataType for d in dims}
    numeric = [d for d in dims if isinstance(kinds[d], T.NumericType)]
    bounds = docs.agg(F.count(F.lit(1)), *[f(col(d).cast("double")) for d in numeric for f in (F.min, F.max)]).first()
    span = {d: (bounds[1 + 2 * i] or 0.0, bounds[2 + 2 * i] or 0.0) for i, d in enumerate(numeric)}
    text = text_or_empty(text_col)
    tie = F.shiftrightunsigned(F.xxhash64(F.lit("tie"), col(id_col)), 64 - TIE_BITS)
    keys = [(F.shiftleft(_position(d, kinds[d], *span.get(d, (0.0, 0.0))), TIE_BITS) + tie).alias(f"k{i}") for i, d in enumerate(dims)]
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    return save(docs.select(col(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(text, "utf-8")).alias("crc"), *keys), "shard-keys")


def _descend(rows: DataFrame, nodes: dict[int, Node], node: str) -> DataFrame:
    """Move each row from its node to the child it belongs to, or leave it in a leaf."""
    if not nodes:
        return rows
    spark = rows.sparkSession
    table = ", ".join(f"({k}, {n.dim}, {n.cut}L)" for k, n in nodes.items())
    cuts = spark.sql(f"SELECT * FROM VALUES {table} AS t({node}, cut_dim, cut_at)")
    dims = [c for c in rows.columns if c[0] == "k" and c[1:].isdigit()]
    key = F.coalesce(*[F.when(F.col("cut_dim") == int(c[1:]), F.col(c)) for c in dims])
    child = F.when(F.col("cut_at").isNotNull(), F.col(node) * 2 + F.when(key < F.col("cut_at"), 0).otherwise(1))  # null in a leaf
    moved = rows.join(F.broadcast(cuts), node, "left")  # one row for each node, as many as shards
    return moved.withColumn(node, F.coalesce(child, F.col(node))).drop("cut_dim", "cut_at")


def _cut_level(rows: DataFrame, nodes: dict[int, Node], dims: int) -> None:
    """Choose dimension and cut of every node of a level."""
    inside = rows.where(F.col("node").isin(list(nodes))) if len(nodes) < 64 else rows
    sums = inside.groupBy("node").agg(F.sum("size").alias("w"), *[f(F.shiftright(f"k{i}", TIE_BITS)).alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)])
    weight: dict[int, int] = {}
    for r in sums.collect():
        if r["node"] in nodes:
            weight[r["node"]] = r["w"]
            widths = [r[f"max{i}"] - r[f"min{i}"] for i in range(dims)]
            nodes[r["node"]].dim = max(range(dims), key=lambda i: widths[i])
    want = {k: weight[k] * (n.shards // 2) / n.shards for k, n in nodes.items() if k in weight}
    prefix, before, known = {k: 0 for k in want}, {k: 0 for k in want}, 0
    open_nodes = set(want)
    bits = COORDINATE_BITS + TIE_BITS
    while open_nodes and known < bits:
        step = min(bits - known, max(1, (HISTOGRAM // len(open_nodes)).bit_length() - 1))
        table = ", ".join(f"({k}, {nodes[k].dim}, {prefix[k]}L)" for k in sorted(open_nodes))
        at = rows.sparkSession.sql(f"SELECT * FROM VALUES {table} AS t(node, at_dim, at_prefix)")
        key = F.coalesce(*[F.when(F.col("at_dim") == i, F.col(f"k{i}")) for i in range(dims)])
        near = rows.join(F.broadcast(at), "node").select("node", "size", "at_prefix", key.alias("key"))
        near = near.where(F.shiftright("key", bits - known) == F.col("at_prefix"))
        bin_ = F.shiftright("key", bits - known - step)
        found: dict[int, list[tuple[int, int]]] = {}
        for r in near.groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("w")).collect():
            found.setdefault(r["node"], []).append((r["bin"], r["w"]))
        known += step
        for k in list(open_nodes):
            for b, w in sorted(found.get(k, [])):
                if before[k] + w > want[k]:
                    prefix[k] = b
                    break
                before[k] += w
            else:
                prefix[k] = (prefix[k] << step) + (1 << step)  # all of it is before the cut
                nodes[k].cut = prefix[k] << (bits - known)
                open_nodes.discard(k)
                continue
            if known == bits or w <= TOLERANCE * weight[k] / nodes[k].shards:
                later = before[k] + w - want[k] < want[k] - before[k]  # the nearer side of the last bin
                nodes[k].cut = (prefix[k] + later) << (bits - known)
                open_nodes.discard(k)


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """id, size, crc, shard and slot of every row; give ``shards`` or ``target_bytes``."""
    rows = _narrow(docs, id_col, text_col, list(dims)).withColumn("node", F.lit(1).cast("long"))
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    shards = shards or max(1, -(-(total or 0) // (target_bytes or 1 << 30)))
    level, leaves = {1: Node(shards, 0)}, {}
    while level:
        split = {k: n for k, n in level.items() if n.shards > 1}
        leaves |= {k: n for k, n in level.items() if n.shards == 1}
        if split:
            _cut_level(rows, split, len(dims))
            rows = _descend(rows, split, "node")
        level = {2 * k: Node(n.shards // 2, n.first) for k, n in split.items()} | {2 * k + 1: Node(n.shards - n.shards // 2, n.first + n.shards // 2) for k, n in split.items()}
    table = ", ".join(f"({k}, {n.first})" for k, n in leaves.items())
    named = rows.sparkSession.sql(f"SELECT * FROM VALUES {table} AS t(node, shard)")
    return _slots(rows.join(F.broadcast(named), "node").select("id", "size", "crc", "shard"), count, shards)


def _slots(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Number the rows of each shard from 0, in parts of about SLOT_ROWS rows."""
    parts = max(16, -(-count // SLOT_ROWS // shards))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))  # shards x parts rows
    starts = counts.selectExpr("shard", "part", "sum(rows) OVER (PARTITION BY shard ORDER BY part) - rows AS start")
    numbered = dealt.selectExpr("*", "row_number() OVER (PARTITION BY shard, part ORDER BY id, crc) AS nth")
    return numbered.join(F.broadcast(starts), ["shard", "part"]).selectExpr("id", "size", "crc", "shard", "start + nth - 1 AS slot")


def op1_kd_sharding(spark, sf_dir: str) -> DataFrame:
    placed = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
