"""A prefix tree of conversations from owned chains.

A node is a distinct sequence of first turns, and its owner is the smallest conversation
that begins with it. Who owns a prefix owns every longer prefix of its own, so the
nodes of an owner form one chain, from its first owned depth down to its last turn.

1. Turns are placed, rebuilt (each conversation takes over the first turns of a base
   conversation), and every prefix gets a digest: running sums of keyed hashes of the
   turns. The key is drawn anew for each run, so equal digests can't be forged.
2. Minima: one aggregation over all prefixes gives owner and number of members of each.
3. Search: prefixes travel in blocks of 64 depths. One batched join of the blocks'
   last prefixes with the minima finds each conversation's first block with an owned
   prefix; within it the first owned depth is found by binary search, all
   conversations at once: a join with the minima for each of six halvings.
4. Tree: a chain hangs below the owner of the prefix before its first. Leaves and tokens of
   chains are summed bottom-up by doubling: after round r a chain holds the sums of
   descendants less than 2^r above it, so a path of any height takes few rounds.
5. Within a chain, suffix sums of what hangs at each node give the node's subtree.

No group is gathered in one task: a conversation, however long, is placed and summed in
two levels, first within ranges of its turns, then over the few ranges. Minima,
sums of chains and children are pre-aggregated; hot prefixes and hot parents are
joined through ``join_groups``. The identifiers that end at a node are written out by range;
only the hash itself, which SHA-256 makes one byte after the other, runs
through the pieces of a node in one task, holding one piece at a time. All tables
between steps are Parquet in the shared folder.

Defined results: null role or text counts as empty, a null turn comes first, equal turns
of a conversation are ordered by role and text, and repeated rows are turns of
their own. Rows without a conversation id belong to no conversation. An absent base
gives no turns; a conversation that is left without turns ends at the root. An empty table has
no conversation and no node, the root neither. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import col, discard, join_groups, save, text_or_empty

#: Prefixes of a conversation that travel in one row.
BLOCK = 64
_LANES = 4
_EMPTY = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the running sums of ``sums`` over each ``key`` in ``order``, own row included.

    Rows are dealt by ranges of (key, order) and summed within each range. Only keys
    at the edge of a range reach into another one; their sums of earlier ranges, at
    most two rows a range, are broadcast.
    """
    valued = rows.select("*", *[v.cast("long").alias(f"_{c}") for c, v in sums.items()])
    dealt = save(valued.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()), name)
    ends = dealt.groupBy("_part").agg(F.array(F.min(key), F.max(key)).alias("edge")).select(F.explode("edge").alias(key)).distinct()
    parts = dealt.join(F.broadcast(ends), key, "left_semi").groupBy(key, "_part").agg(*[F.sum(f"_{c}").alias(f"_{c}") for c in sums])
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select(key, "_part", *[F.sum(f"_{c}").over(before).alias(f"before_{c}") for c in sums]).where(" OR ".join(f"before_{c} IS NOT NULL" for c in sums))
    own = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select(*rows.columns, "_part", *[F.sum(f"_{c}").over(own).alias(f"_{c}") for c in sums])
    met = summed.join(F.broadcast(earlier), [key, "_part"], "left")
    return met.select(*rows.columns, *[(F.col(f"_{c}") + F.coalesce(f"before_{c}", F.lit(0))).alias(c) for c in sums])


def rebuilt_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, stride: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, length, content, bytes) of the rebuilt conversations, and (conv, length) of all."""
    read = df.select(col(conv_col).cast("long").alias("conv"), col(turn_col).alias("turn"), text_or_empty(role_col).alias("role"), text_or_empty(text_col).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = running(read.where("conv IS NOT NULL"), "conv", order, {"pos": F.lit(1)}, "turns-by-range")
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turns = save(placed.select("conv", "pos", content.alias("content"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    counts = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    lengths = counts.select("conv", "n", taken.alias("h"), (F.col("conv") - F.col("conv") % stride).alias("base"))
    bases = counts.where(F.col("conv") % stride == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    lengths = lengths.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("base_n", F.lit(0))))
    lengths = save(lengths.select("conv", "n", "h", "base", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "lengths")
    total = turns.count()
    own = join_groups(turns, lengths, "conv", "n", total).where("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("b")).alias("depth"), "length", "content", "bytes")
    given = turns.where((F.col("pos") < most) & (F.col("conv") % stride == 0)).withColumnRenamed("conv", "base")  # at most most - 1 rows of a base
    given = given.join(lengths.select("conv", "base", "b", "length"), "base").where("pos <= b").select("conv", F.col("pos").alias("depth"), "length", "content", "bytes")
    return own.unionByName(given), lengths.select("conv", "length")


def prefixes_of(turns: DataFrame) -> DataFrame:
    """(conv, depth, length, key, bytes): every prefix with a digest of 128 bits."""
    keyed = F.sha2(F.concat(F.lit(secrets.token_hex(16)), F.col("depth").cast("string"), F.lit(":"), "content"), 256)
    hashed = turns.select("conv", "depth", "length", "bytes", keyed.alias("hex"))
    lanes = {f"lane{i}": F.conv(F.substring("hex", 8 * i + 1, 8), 16, 10) for i in range(_LANES)}
    summed = running(hashed.select("conv", "depth", "length", "bytes", "hex"), "conv", [F.col("depth")], lanes, "turns-hashed")
    low = lambda i: F.col(f"lane{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    pair = lambda i: F.shiftleft(low(i), 32).bitwiseOR(low(i + 1))
    return summed.select("conv", "depth", "length", F.struct("depth", pair(0).alias("x"), pair(2).alias("y")).alias("key"), "bytes")


class _Minima:
    """Owner and members of every prefix."""

    def __init__(self, prefixes: DataFrame):
        self.table = save(prefixes.groupBy("key").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes")), "prefix-minima")
        self.total = prefixes.count()

    def owners(self, rows: DataFrame, key: Column) -> DataFrame:
        """``rows`` with the owner of the prefix ``key``."""
        return join_groups(rows.withColumn("key", key), self.table.select("key", "owner", "n_convs"), "key", "n_convs", self.total).drop("key", "n_convs")


def _first_owned(prefixes: DataFrame, minima: _Minima) -> tuple[DataFrame, DataFrame]:
    """Chains (conv, f, length, parent, a) below the root, and (conv, depth, owner) of the last prefix of each conversation."""
    block = F.floor((F.col("depth") - 1) / BLOCK)
    # the last prefix of a block also begins the next one: what the first owned prefix hangs on is always at hand
    both = F.when((F.col("depth") % BLOCK == 0) & (F.col("depth") < F.col("length")), F.array(block, block + 1)).otherwise(F.array(block))
    blocks = prefixes.select("conv", "length", "key", F.explode(both).alias("block")).groupBy("conv", "block")
    blocks = blocks.agg(F.array_sort(F.collect_list("key")).alias("keys"), F.first("length").alias("length"))
    probed = save(minima.owners(blocks, F.element_at("keys", -1)), "blocks-probed")
    ends = probed.where(F.element_at("keys", -1)["depth"] == F.col("length")).select("conv", F.col("length").alias("depth"), "owner")
    first = probed.where("owner = conv").groupBy("conv").agg(F.min_by(F.struct("keys", "length"), "block").alias("r"))
    state = save(first.select("conv", F.col("r.length").alias("length"), F.col("r.keys").alias("keys"), F.lit(0).alias("lo"), (F.size("r.keys") - 1).alias("hi")), "search")
    done = []
    while True:
        done.append(state.where("lo >= hi"))
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        met = minima.owners(open_.withColumn("mid", mid), F.col("keys")[mid])
        state = save(met.select("conv", "length", "keys", F.when(F.col("owner") == F.col("conv"), F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"), F.when(F.col("owner") == F.col("conv"), F.col("mid")).otherwise(F.col("hi")).alias("hi")), "search")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = save(found.select("conv", "length", F.col("keys")[F.col("lo")]["depth"].alias("f"), F.when(F.col("lo") > 0, F.col("keys")[F.greatest(F.col("lo") - 1, F.lit(0))]).alias("above")), "owned")
    hung = minima.owners(found.where("above IS NOT NULL"), F.col("above")).select("conv", "f", "length", F.col("owner").alias("parent"))
    return hung.unionByName(found.where("above IS NULL").select("conv", "f", "length", F.lit(None).cast("long").alias("parent"))), ends


def subtree_sums(chains: DataFrame, sums: list[str]) -> DataFrame:
    """(conv, ``sums``) with each chain's own values and those of all chains below it, by doubling."""
    now = save(chains.select("conv", *sums), "chain-sums")
    above = save(chains.where("parent IS NOT NULL").select("conv", F.col("parent").alias("up")), "chains-above")
    while not above.isEmpty():
        add = above.join(now, "conv").groupBy(F.col("up").alias("conv")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums], F.count(F.lit(1)).alias("size"))
        add = save(add, "chain-more")
        after = save(now.join(add, "conv", "left").select("conv", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums]), "chain-sums")
        higher = above.join(add.select("conv", "size"), "conv").select(F.col("conv").alias("up"), F.col("up").alias("top"), "size")
        next_ = save(join_groups(above, higher, "up", "size", above.count()).select("conv", F.col("top").alias("up")), "chains-above")
        discard(now, above, add)
        now, above = after, next_
    return now


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order, one after the other."""
    node, state = None, None
    out = []
    for batch in batches:
        for owner, depth, piece in zip(*[batch.column(c).to_pylist() for c in ("owner", "depth", "piece")], strict=True):
            if (owner, depth) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
    if node is not None:
        out.append((*node, state.hexdigest()))
    for at in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000], strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["owner", "depth", "sha"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, sha) of the sorted decimal ids that end at each node, joined by commas."""
    dealt = save(ends.select("owner", "depth", "conv").repartitionByRange("owner", "depth", "conv").withColumn("part", F.spark_partition_id()), "ends-by-range")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = save(dealt.groupBy("owner", "depth", "part").agg(joined.alias("piece")), "ends-pieces")
    several = pieces.groupBy("owner", "depth").count().where("count > 1").select("owner", "depth")
    one = pieces.join(F.broadcast(several), ["owner", "depth"], "left_anti").select("owner", "depth", F.sha2("piece", 256).alias("sha"))
    # nodes that reach over an edge between two ranges: fewer than there are ranges
    many = pieces.join(F.broadcast(several), ["owner", "depth"], "left_semi").repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part")
    return one.unionByName(many.select("owner", "depth", "piece").mapInArrow(_hash_pieces, "owner long, depth long, sha string"))


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stride: int = 5, most: int = 9) -> DataFrame:
    """conv, depth, parent, n_convs, n_children, n_leaves, saved, ends of every node."""
    turns, lengths = rebuilt_turns(df, conv_col, turn_col, role_col, text_col, stride, most)
    prefixes = save(prefixes_of(turns), "prefixes")
    minima = _Minima(prefixes)
    below, ends = _first_owned(prefixes, minima)
    n, root = lengths.agg(F.count(F.lit(1)), F.min("conv")).first()
    no_long = F.lit(None).cast("long")
    root_depth = F.when(F.col("conv") == F.lit(root), F.lit(0)).otherwise(F.col("f"))
    # the smallest conversation owns the root too; a chain that hangs on no turn hangs on the root
    chains = below.select("conv", root_depth.cast("long").alias("f"), "length", F.when(F.col("conv") != F.lit(root), F.coalesce("parent", F.lit(root))).alias("parent"))
    bare = lengths.where((F.col("conv") == F.lit(root)) & (F.col("length") == 0)).select("conv", F.lit(0).cast("long").alias("f"), "length", no_long.alias("parent"))
    chains = save(chains.unionByName(bare), "chains")

    tokens = (F.col("n_convs") - 1) * F.col("bytes")
    nodes = minima.table.select(F.col("owner").alias("conv"), F.col("key.depth").alias("depth"), "n_convs", tokens.alias("tokens"))
    if n:
        nodes = nodes.unionByName(df.sparkSession.createDataFrame([(root, 0, n, 0)], "conv long, depth long, n_convs long, tokens long"))
    nodes = save(nodes, "nodes")
    hung = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv"), (F.col("f") - 1).alias("length")).agg(F.count(F.lit(1)).alias("hung"))
    own = chains.join(nodes.groupBy("conv").agg(F.sum("tokens").alias("saved")), "conv").join(hung, ["conv", "length"], "left")
    own = save(own.select("conv", "parent", F.col("hung").isNull().cast("long").alias("leaves"), "saved"), "chains-own")
    sums = subtree_sums(own, ["leaves", "saved"])

    done = lengths.where("length = 0").select("conv", F.col("length").alias("depth"), F.lit(root).cast("long").alias("owner"))
    digests = ends_digests(ends.unionByName(done))
    blank = {"parent": no_long, "n_convs": no_long, "last": no_long, "children": no_long, "leaves": no_long, "saved": no_long, "ends": F.lit(None).cast("string")}
    told = lambda rows, **have: rows.select("conv", "depth", *[have.get(c, v).alias(c) for c, v in blank.items()])
    parts = [
        told(nodes, n_convs=F.col("n_convs"), saved=F.col("tokens")),
        told(chains.withColumn("depth", F.col("f")), parent=F.col("parent")),
        told(chains.withColumn("depth", F.col("length")), last=F.lit(1).cast("long")),
        told(chains.join(sums, "conv").where("parent IS NOT NULL").select(F.col("parent").alias("conv"), (F.col("f") - 1).alias("depth"), "leaves", "saved"), children=F.lit(1).cast("long"), leaves=F.col("leaves"), saved=F.col("saved")),
        told(digests.withColumnRenamed("owner", "conv"), ends=F.col("sha")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    each = every.groupBy("conv", "depth").agg(F.max("n_convs").alias("n_convs"), F.max("parent").alias("parent"), F.max("last").alias("last"), zero("children").alias("children"), zero("leaves").alias("hung_leaves"), zero("saved").alias("hung_saved"), F.max("ends").alias("ends"))
    leaf = (F.col("last").isNotNull() & (F.col("children") == 0)).cast("long")
    whole = running(each, "conv", [F.col("depth").desc()], {"leaves": F.col("hung_leaves") + leaf, "saved": F.col("hung_saved")}, "nodes-summed")
    discard(prefixes)
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv"))
    children = F.col("children") + F.col("last").isNull().cast("long")
    return whole.select("conv", "depth", parent.alias("parent"), "n_convs", children.alias("n_children"), F.col("leaves").alias("n_leaves"), "saved", F.coalesce("ends", F.lit(_EMPTY)).alias("ends"))


def op12_owned_chains(spark, sf_dir: str) -> DataFrame:
    found = prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    names = {"conv": "conv_id", "parent": "parent_conv_id", "saved": "saved_tokens", "ends": "ends_sha256"}
    return found.select([F.col(c).alias(names.get(c, c)) for c in found.columns])


OP12_SQL = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (SELECT c, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
          lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, y: xor(b >> 1, 3988292384::BIGINT * (b & 1)))), 4294967295::BIGINT) % 9 AS h
        FROM (SELECT c, count(*) AS n FROM t GROUP BY c)),
b AS (SELECT x.c, x.h, x.c - x.c % 5 AS base, least(x.h, coalesce(y.n, 0)) AS b FROM crc x LEFT JOIN crc y ON y.c = x.c - x.c % 5),
r AS (SELECT b.c, t.pos AS d, role, text FROM b JOIN t ON t.c = b.base WHERE t.pos <= b.b
      UNION ALL SELECT b.c, t.pos - b.h + b.b, role, text FROM b JOIN t ON t.c = b.c WHERE t.pos > b.h),
w AS (SELECT b.c, coalesce(list({'r': role, 't': text} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS ts FROM b LEFT JOIN r ON r.c = b.c GROUP BY b.c),
p AS (SELECT c, d, ts[1 : d] AS k, len(ts) AS n FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM w)),
o AS (SELECT k, any_value(d) AS d, min(c) AS c, count(*) AS m, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d) AS ends FROM p GROUP BY k),
u AS (SELECT o.*, (SELECT count(*) FROM o x WHERE x.d = o.d + 1 AND x.k[1 : o.d] = o.k) AS kids FROM o)
SELECT u.c AS conv_id, u.d AS depth, (SELECT x.c FROM o x WHERE x.d = u.d - 1 AND x.k = u.k[1 : u.d - 1]) AS parent_conv_id, u.m AS n_convs, u.kids AS n_children,
       (SELECT count(*) FROM u y WHERE y.kids = 0 AND y.d >= u.d AND y.k[1 : u.d] = u.k) AS n_leaves,
       (SELECT CAST(sum((y.m - 1) * CASE WHEN y.d = 0 THEN 0 ELSE strlen(y.k[y.d].t) END) AS BIGINT) FROM u y WHERE y.d >= u.d AND y.k[1 : u.d] = u.k) AS saved_tokens,
       sha256(coalesce(u.ends, '')) AS ends_sha256
FROM u
"""
