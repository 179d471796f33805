"""Running aggregates over keys of any size, and sequential packing by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..paths import scratch

_MERGE = {"sum": F.sum, "max": F.max, "count": F.sum}
_EACH = {"sum": F.sum, "max": F.max, "count": F.count}


def saved(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again, so that a later step does not make them anew."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def running(rows: DataFrame, keys: list[str], order: list[Column], what: dict[str, tuple[str, Column]], own: bool = True) -> DataFrame:
    """``rows`` with running aggregates (sum, max or count) over each key in ``order``, own row included or not.

    Rows are dealt by ranges of (keys, order), so a key with a third of all rows is
    spread over many tasks. Each range is summed by itself; only keys at its
    edges reach into another range, and what earlier ranges add to them, two rows a
    range at most, is broadcast.
    """
    valued = rows.select("*", *[v.alias(f"_{c}") for c, (_, v) in what.items()])
    dealt = saved(valued.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    key = F.struct(*keys)
    edges = dealt.groupBy("_part").agg(F.array(F.min(key), F.max(key)).alias("e")).select(F.explode("e").alias("e")).select("e.*").distinct()
    parts = dealt.join(F.broadcast(edges), keys, "left_semi").groupBy(*keys, "_part").agg(*[_EACH[a](f"_{c}").alias(f"_{c}") for c, (a, _) in what.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select(*keys, "_part", *[_MERGE[a](f"_{c}").over(before).alias(f"_before_{c}") for c, (a, _) in what.items()])
    here = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    summed = dealt.select(*rows.columns, "_part", *[_EACH[a](f"_{c}").over(here).alias(f"_{c}") for c, (a, _) in what.items()])
    met = summed.join(F.broadcast(earlier), [*keys, "_part"], "left")
    both = {"sum": lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)), "count": lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)), "max": F.greatest}
    return met.select(*rows.columns, *[both[a](F.col(f"_{c}"), F.col(f"_before_{c}")).alias(c) for c, (a, _) in what.items()])


def packed(items: DataFrame, keys: list[str], order: list[Column], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Greedy records of consecutive items: ``keys``, record (from 0), first (item number from 1), rows, size, last, oversize.

    An item opens a new record when it would overflow the one before it; an item that is
    too large by itself is a record of its own, marked ``oversize``. Keys whose items
    fit together are one record and go no further. For the others the first item that a
    record from item i leaves out is found on the running sums of sizes, and the
    records that begin at item 1, at its next, at the next of that, and so on are
    collected by jumps of 1, 2, 4, ... records: as many rounds as the number of records has digits.
    """
    sized = items.withColumn("_size", F.col(size).cast("long"))
    whole = saved(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("total")), "pack-totals")
    fits = (F.col("n") <= most_rows) & ((F.col("total") <= most_size) | (F.col("n") == 1))
    one = whole.where(fits).select(*keys, F.lit(0).cast("long").alias("record"), F.lit(1).cast("long").alias("first"), F.col("n").alias("rows"), F.col("total").alias("size"), F.lit(True).alias("last"), (F.col("total") > most_size).alias("oversize"))
    large = whole.where(~fits)
    if large.isEmpty():
        return one
    placed = saved(running(sized.join(large.select(*keys), keys, "left_semi"), keys, order, {"i": ("count", F.lit(1)), "s": ("sum", F.col("_size"))}).select(*keys, "i", "s", "_size"), "pack-items")
    # among running sums and targets in one order, the sums up to a target are counted
    sums = placed.select(*keys, F.col("s").alias("at"), F.lit(0).alias("kind"), F.col("i"), F.lit(1).alias("one"))
    aims = placed.select(*keys, (F.col("s") - F.col("_size") + most_size).alias("at"), F.lit(1).alias("kind"), "i", F.lit(0).alias("one"))
    counted = running(sums.unionByName(aims), keys, [F.col("at"), F.col("kind"), F.col("i")], {"fit": ("sum", F.col("one"))}).where("kind = 1")
    next_ = F.greatest(F.col("i") + 1, F.least(F.col("fit"), F.col("i") + most_rows - 1) + 1)
    steps = saved(counted.select(*keys, "i", next_.cast("long").alias("j")).join(F.broadcast(large.select(*keys, "n")) if large.count() <= 100_000 else large.select(*keys, "n"), keys), "pack-next")
    jumps = saved(steps.where("j <= n").select(*keys, "i", "j"), "pack-jumps")
    begins, known = saved(large.select(*keys, F.lit(1).cast("long").alias("i")), "pack-begins"), 0
    while (size_now := begins.count()) > known:
        known = size_now
        begins = saved(begins.unionByName(begins.join(jumps, [*keys, "i"]).select(*keys, F.col("j").alias("i"))).distinct(), "pack-begins")
        further = jumps.select(*keys, F.col("i").alias("j"), F.col("j").alias("k"))
        jumps = saved(jumps.join(further, [*keys, "j"]).select(*keys, "i", F.col("k").alias("j")), "pack-jumps")
    records = begins.join(steps, [*keys, "i"]).select(*keys, F.col("i").alias("first"), (F.col("j") - 1).alias("i"), (F.col("j") > F.col("n")).alias("last"))
    ended = records.join(placed.select(*keys, "i", "s"), [*keys, "i"]).select(*keys, "first", F.col("i").alias("end"), F.col("s").alias("upto"), "last")
    sizes = ended.join(placed.select(*keys, F.col("i").alias("first"), (F.col("s") - F.col("_size")).alias("before")), [*keys, "first"])
    told = running(sizes, keys, [F.col("first")], {"nth": ("count", F.lit(1))})
    size_of = F.col("upto") - F.col("before")
    return one.unionByName(told.select(*keys, (F.col("nth") - 1).cast("long").alias("record"), "first", (F.col("end") - F.col("first") + 1).alias("rows"), size_of.alias("size"), "last", (size_of > most_size).alias("oversize")))
