"""MinHash near-deduplication by a signature-coordinate inverted join.

1. A document's set of word shingles gives a signature of ``coordinates`` minima.
   Documents with equal sets (128-bit digests of whole sets) are one class; only
   classes go on, so copies are never expanded into pairs.
2. Inverted join: a class is posted under each pair (coordinate, value). Lists of
   one posting are dropped, and classes with fewer than ``matches`` postings left.
3. Skip merging: most members of a list belong together, and one good link joins
   each of them. Every list names its hub, the member in the most and longest lists; the
   lists are merged as (hub, member) only, a number linear in the postings, and
   collisions are counted while merging. A pair that reaches ``matches`` there is
   retained; for the others the skipped lists are settled by the hub's signature.
4. Prefix merging: for what the hubs leave over, classes of different components are
   merged on their shingles in order of rarity. Of two sets of n >= m shingles that
   are similar enough, the larger has a common shingle among its first n - least(n) + 1,
   least being the overlap that the similarity needs with the smallest partner, and the
   smaller among its first m - least(m, m) + 1. Each posting of the smaller side goes to
   the size classes that its place in the set allows, so lists are cut by size
   before they are joined; lists in one component only are skipped.
5. Pairs are retained above the match threshold and confirmed on the full sets.
6. Connected components by alternating large-star and small-star steps.

Words are hashed under a key drawn for each run, so texts can't be made to share
shingles that differ.

At similarity 0.8 exactly, the 48 coordinates agree in 38 on average (deviation
2.8); fewer than 22 happen once in 10^8 pairs, so practically no link is lost.

Hot hubs, vertices and components: rows meet their groups through ``join_groups``
(hot keys broadcast, bounded). Postings meet their lists through ``join_dealt`` (hot
lists in parts), so they are made once. The set of a hub is not copied beside its
members: pairs are dealt to groups of bounded size by (hub, salt), and a group gets a hub's
set once. Long lists of step 4 are salted. Lineage is cut by Parquet tables in the
shared folder, which go when nothing reads them any more.

Defined results: a null text has no words, its set is empty, and it is linked
with nothing: its component is its own id. A row with a null id is linked with
nothing, has a null component and is kept. Repeated rows share a class and so a
component; kept is true for all rows with the component's id. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import col, discard, join_dealt, join_groups, save, text_or_empty
from .arrays import Words, batches_of, fresh_key, mix, multipliers

COORDINATES, MATCHES = 48, 22


def shingle_sets(texts: list[bytes], width: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, and where each text begins."""
    words = Words(texts, key)
    counts, owners = words.counts(), words.owners()
    at = np.flatnonzero(words.whole(width))
    hashes, owner = words.windows(width)[at], owners[at]
    short = np.flatnonzero((counts > 0) & (counts < width))  # the whole sequence is one shingle
    if len(short):
        place = np.arange(len(owners)) - words.first[owners]
        few = np.flatnonzero(counts[owners] < width)
        sums = np.zeros(len(counts), np.uint64)
        np.add.at(sums, owners[few], words.hashes[few] * multipliers(width, 7)[place[few]])
        hashes = np.concatenate([hashes, mix(sums[short] + counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _digests(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit digest of each set."""
    sums = []
    for seed in (np.uint64(11), np.uint64(23)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + mix(np.array([seed]))))])
        sums.append(total[first[1:]] - total[first[:-1]])
    return [a.tobytes() + b.tobytes() for a, b in zip(*sums, strict=True)]


def _signatures(width: int, coordinates: int, key: int):
    factors = multipliers(coordinates, 3)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids, shas = [t.encode().lower() for t in batch["text"]], batch["id"], batch["sha"]
            for a, z in batches_of(texts, 1 << 20):
                hashes, first = shingle_sets(texts[a:z], width, key)
                n = np.diff(first)
                full = np.flatnonzero(n)
                minima = np.zeros((z - a, coordinates), np.int32)
                for k, f in enumerate(factors):
                    if len(full):
                        minima[full, k] = (np.minimum.reduceat(mix(hashes * f), first[full]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pd.DataFrame({"id": ids.iloc[a:z].astype("Int64").array, "n": n, "v": _digests(hashes, first), "sig": list(minima), "sha": shas.iloc[a:z].array})

    return sign


def _sets(width: int, key: int):
    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode().lower() for t in batch["text"]]
            for a, z in batches_of(texts):
                hashes, first = shingle_sets(texts[a:z], width, key)
                own = _digests(hashes, first)
                rows = [(v, hashes[first[i] : first[i + 1]].view(np.int64)) for i, v in enumerate(own) if v == bytes(batch["v"].iloc[a + i])]
                yield pd.DataFrame(rows, columns=["v", "set"])

    return collect


def _meets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def confirm(members: pd.DataFrame, hubs: pd.DataFrame) -> pd.DataFrame:
        """Links among (a, b, set_b); hubs has the set of each a once."""
        sets = dict(zip(hubs["hub"], hubs["hub_set"], strict=True))
        links = [(a, b) for a, b, y in zip(members["a"], members["b"], members["set_b"], strict=True) if _meets(sets[a], y, percent)]
        return pd.DataFrame(links, columns=["a", "b"])

    return confirm


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of the edges (a, b); root is the smallest of its component."""
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark, total = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size")).select("a", F.least("a", "m").alias("m"), "size")
        large = join_groups(both, least, "a", "size", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = save(large, "edges-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("size"))
        small = join_groups(large, least, "a", "size", total).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now, large)
        now, before = after, mark
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == before:
            roots = now.select(F.col("a").alias("v"), F.col("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


class _Links:
    """Candidates of (v, n, sig) classes: counted on signatures, confirmed on sets."""

    def __init__(self, classes: DataFrame, sets: DataFrame, matches: int, percent: int):
        self.classes, self.sets, self.matches, self.percent = classes, sets, matches, percent

    def counted(self, pairs: DataFrame, total: int) -> DataFrame:
        """Of distinct pairs (a, b) with a count of collisions so far, those with ``matches`` or more in all."""
        short = pairs.where(F.col("collisions") < self.matches).select("a", "b")
        side = lambda x: self.classes.select(F.col("v").alias(x), F.col("sig").alias(f"sig_{x}"))
        hubs = short.groupBy("a").agg(F.count(F.lit(1)).alias("size")).join(side("a"), "a")
        signed = join_groups(short, hubs, "a", "size", total).join(side("b"), "b")
        equal = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
        return pairs.where(F.col("collisions") >= self.matches).select("a", "b").unionByName(signed.where(equal >= self.matches).select("a", "b"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among distinct candidate pairs (a, b, collisions)."""
        pairs = save(pairs, "pairs")
        likely = save(self.counted(pairs, pairs.count()), "likely")
        sizes = self.sets.select("v", F.size("set").alias("n"))
        bytes_b = likely.select(F.col("b").alias("v")).join(sizes, "v").agg(F.sum("n")).first()[0] or 0
        groups = max(4 * int(likely.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(bytes_b * 8 // GROUP_BYTES, 1 << 20))
        salted = likely.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        counts = salted.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
        spread = F.least(F.lit(SALTS), F.ceil(F.col("m") / MEMBERS)).cast("int")
        salted = join_groups(salted, counts.withColumn("spread", spread), "a", "m", likely.count()).withColumn("salt", F.col("salt") % F.col("spread"))
        salted = save(salted.select("a", "b", F.pmod(F.xxhash64("a", "salt"), F.lit(groups)).cast("int").alias("g")), "dealt")
        members = salted.join(self.sets.select(F.col("v").alias("b"), F.col("set").alias("set_b")), "b")
        hubs = salted.select(F.col("a").alias("hub"), F.col("g").alias("h")).distinct().join(self.sets.select(F.col("v").alias("hub"), F.col("set").alias("hub_set")), "hub")
        links = save(members.groupBy("g").cogroup(hubs.groupBy("h")).applyInPandas(_confirm(self.percent), "a binary, b binary"), "links")
        discard(pairs, likely, salted)
        return links


#: A hub's members are dealt to groups of about so many, by at most SALTS salts; a group holds about GROUP_BYTES of sets.
MEMBERS, SALTS, GROUP_BYTES = 64, 1 << 16, 1 << 23
#: Rows of a list of shingles that meet all of its other side in one task.
LIST_ROWS = 1000
#: Keys right before a posting's own, by which a pair that met already is known.
EARLIER = 8
#: Sizes of sets in one class differ by at most this factor.
SIZE_STEP = 1.03


def _close(a: str, b: str, percent: int):
    """Set sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _hub_pairs(lists: DataFrame, hubs: DataFrame, total: int, percent: int) -> DataFrame:
    """(hub, member, collisions in the lists merged); hubs holds key, size, hub and hub_n."""
    met = join_groups(lists.select("key", "v", "n"), hubs, "key", "size", total)
    met = met.where((F.col("hub") != F.col("v")) & _close("n", "hub_n", percent))
    return met.groupBy(F.col("hub").alias("a"), F.col("v").alias("b")).agg(F.count(F.lit(1)).alias("collisions"))


def _prefix_pairs(sets: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a shingle rare enough for both."""
    every = sets.select("v", F.size("set").alias("n"), F.explode("set").alias("key"))
    counts = save(every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shingle-counts")
    total = sets.agg(F.sum(F.size("set"))).first()[0] or 0
    met = join_dealt(every, counts, "key", "size", total, "v")  # shingles of one set alone come first and meet nothing
    own = Window.partitionBy("v")
    nth = F.row_number().over(own.orderBy("size", "key")) + F.col("n") - F.count(F.lit(1)).over(own)
    prefix = met.withColumn("nth", nth).where(100 * (F.col("n") - F.col("nth") + 1) >= percent * F.col("n"))
    prefix = prefix.select("key", "v", "n", "nth").join(grouped, "v", "left").withColumn("root", F.coalesce("root", "v"))
    prefix = save(prefix, "prefixes")
    mixed = prefix.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("z"), F.count(F.lit(1)).alias("size")).where("x != z").select("key", "size")
    left = join_dealt(prefix, save(mixed, "lists-open"), "key", "size", prefix.count(), "v")
    left = save(left.withColumn("before", F.collect_list("key").over(own.orderBy("nth").rowsBetween(-EARLIER, -1))), "prefixes-open")
    # the smaller side: the overlap with a set of n shingles, at most m - nth + 1, must reach percent / (100 + percent) of n + m
    most = F.expr(f"least((n - nth + 1) * {100 + percent} div {percent} - n, n * 100 div {percent})")  # the largest partner
    sized = lambda c: F.floor(F.log(c.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")
    salts = (F.col("size") / LIST_ROWS).cast("int")
    small = left.withColumn("most", most).where(F.col("most") >= F.col("n"))
    small = small.select(
        "key", F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("nth").alias("nth_b"), F.col("root").alias("root_b"), F.col("before").alias("before_b"), salts.alias("salts"),
        F.explode(F.sequence(sized(F.col("n")), sized(F.col("most")))).alias("class"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.col("salts"))).alias("salt"))
    large = left.select("key", "v", "n", "nth", "root", "before", sized(F.col("n")).alias("class"), F.pmod(F.xxhash64("v"), salts + 1).cast("int").alias("salt"))
    overlap = 1 + F.least(F.col("n") - F.col("nth"), F.col("n_b") - F.col("nth_b"))
    enough = (100 + percent) * overlap >= percent * (F.col("n") + F.col("n_b"))
    # a pair that shares a key shortly before this one meets there: the bounds above only narrow with the place
    fresh = ~F.arrays_overlap("before", "before_b")
    found = large.join(small, ["key", "class", "salt"]).where((F.col("n") >= F.col("n_b")) & (F.col("root") != F.col("root_b")) & _close("n", "n_b", percent) & enough & fresh)
    return found.select(F.least("v", "b").alias("a"), F.greatest("v", "b").alias("b")).distinct().withColumn("collisions", F.lit(0).cast("long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, with_sha: bool = False) -> DataFrame:
    """id, n_shingles, component_id, kept (and sha, SHA-256 of the text) of every row."""
    read = docs.select(col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    word_key = fresh_key()
    sha = F.unhex(F.sha2("text", 256)) if with_sha else F.lit(None).cast("binary")
    signed = save(read.withColumn("sha", sha).mapInPandas(_signatures(width, coordinates, word_key), "id long, n long, v binary, sig array<int>, sha binary"), "signatures")
    linked = signed.where("n > 0 AND id IS NOT NULL")
    classes = save(linked.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    key = lambda: F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posts = classes.select("v", "n", F.posexplode("sig").alias("k", "value")).select("v", "n", key().alias("key"))
    total = classes.count() * coordinates
    sizes = posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = join_dealt(posts, save(sizes, "list-sizes"), "key", "size", total, "v")
    lists = save(lists, "postings")
    popular = lists.groupBy("v").agg(F.sum("size").alias("popularity"), F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= matches)
    shared = save(lists.join(popular, "v"), "postings-shared")  # fewer shared values than matches: no partner

    wanted = shared.select("v").distinct().join(classes.select("v", "rep"), "v").select("v", F.col("rep").alias("id"))
    sets = save(read.join(wanted, "id").select("v", "text").mapInPandas(_sets(width, word_key), "v binary, set array<bigint>").dropDuplicates(["v"]), "shingle-sets")
    links = _Links(classes, sets, matches, percent)

    hub = lambda: F.max(F.struct("popularity", "v", "n"))
    hubs = shared.groupBy("key").agg(F.first("size").alias("size"), hub().alias("h")).select("key", "size", F.col("h.v").alias("hub"), F.col("h.n").alias("hub_n"))
    found = links.confirmed(_hub_pairs(shared, hubs, total, percent))
    grouped = save(components(found), "components")
    found = save(found.unionByName(links.confirmed(_prefix_pairs(sets, grouped, percent))), "links-all")
    grouped = components(found)

    roots = save(classes.select("v", "rep", "rows").join(grouped, "v", "left").withColumn("root", F.coalesce("root", "v")), "roots")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("size"))
    labels = save(join_groups(roots, least, "root", "size", total // coordinates).select("v", "rows", "component_id"), "labels")
    told = join_groups(linked.select("id", "n", "v", "sha"), labels, "v", "rows", total // coordinates)
    alone = signed.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"), "sha")
    every = told.select("id", "n", "component_id", "sha").unionByName(alone)
    discard(classes, lists, shared, sets, found, roots)
    return every.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), *(["sha"] if with_sha else []))


def op7_coordinate_join(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
    return found.withColumnRenamed("id", "doc_id")
