"""Best-fit packing of documents into sequences by a linear grouping scheme.

1. Documents are tokenised where they lie; those longer than a sequence are cut.
   A piece is described by a few numbers, so texts are never shuffled.
2. The plan needs only how many pieces have each length: at most ``capacity``
   numbers, whatever the input. On the driver, lengths above ``capacity / 8`` are
   large: sorted by length they form groups of equal cardinality, each
   rounded up to its longest member. For these few sizes a column-generation
   linear programme finds the mix of configurations; its whole part is taken, and
   actual lengths are substituted for the rounded ones. The freed room takes the
   pieces that fit it best together, found by sums of lengths; so does what is
   free beside the large pieces that no configuration took. The small pieces left
   then are packed best-fit decreasing. Equal sequences are planned as runs, so
   the plan grows with the number of lengths, not of pieces.
3. Pieces get a rank among those of their length (distributed: hot lengths are
   split into parts of RANK_ROWS) and look their place up in the broadcast plan.

Defined results: a null text is the empty text and gives one piece, the closing
id; ties of length are ordered by (id, piece, crc); repeated rows are packed
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import col, save, text_or_empty
from .tokens import vocabulary, word_encoder

CAPACITY = 4096
#: Groups of the linear grouping; lengths above capacity / LARGE are grouped.
GROUPS, LARGE = 48, 8
#: Ways to substitute: how many of a configuration's smallest slots are left open, and whether best sets fill them.
WAYS = ((1, True), (2, True), (0, False))
#: Pieces of one length that one task ranks.
RANK_ROWS = 1 << 16


def tokenised_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary_path: str, capacity: int, closing: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, packed little-endian) of every piece."""
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = word_encoder(vocabulary_path), closing.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text) + end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, p, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": batch["doc_id"].dtype})

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(cut, schema)


def _price(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Unbounded knapsack: the best configuration for these values."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    s = np.array(sizes)
    for c in range(min(sizes), capacity + 1):
        fits = s <= c
        gain = np.where(fits, best[np.maximum(c - s, 0)] + values, -1.0)
        k = int(gain.argmax())
        best[c], took[c] = (gain[k], k) if gain[k] > best[c - 1] else (best[c - 1], -1)
    counts, c = [0] * len(sizes), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 200) -> list[tuple[list[int], int]]:
    """How often to use which configuration: the whole part of a linear programme.

    Column generation with a dense basis of len(sizes) columns.
    """
    n = len(sizes)
    if not n:
        return []
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    used = np.linalg.solve(basis, np.array(demand, float))
    for _ in range(rounds):
        duals = np.linalg.solve(basis.T, np.ones(n))
        value, counts = _price(sizes, np.maximum(duals, 0), capacity)
        if value <= 1 + 1e-7:
            break
        column = np.array(counts, float)
        direction = np.linalg.solve(basis, column)
        rising = direction > 1e-9
        if not rising.any():
            break
        steps = np.where(rising, np.maximum(used, 0) / np.where(rising, direction, 1), np.inf)
        leaves = int(steps.argmin())
        basis[:, leaves] = column
        used = np.linalg.solve(basis, np.array(demand, float))
    left, chosen = list(demand), []
    for k in range(n):
        counts = [int(round(c)) for c in basis[:, k]]
        times = min([int(used[k] + 1e-6), *(left[i] // c for i, c in enumerate(counts) if c)])
        if times > 0:
            chosen.append((counts, times))
            left = [a - c * times for a, c in zip(left, counts, strict=True)]
    return chosen


class _Plan:
    """Runs of equal sequences by their free room, and where pieces were put."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.free: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
        self.rooms: list[int] = []  # sorted
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, rank after, each, first sequence, offset
        self.rank: dict[int, int] = {}

    def open(self, many: int) -> int:
        first, self.sequences = self.sequences, self.sequences + many
        return first

    def offer(self, room: int, first: int, many: int) -> None:
        if room > 0 and many > 0:
            if room not in self.free:
                self.free[room] = []
                bisect.insort(self.rooms, room)
            self.free[room].append((first, many))

    def put(self, length: int, each: int, first: int, many: int, offset: int) -> None:
        """``each`` pieces of ``length`` into every one of ``many`` sequences from ``first``."""
        at = self.rank.get(length, 0)
        self.rank[length] = at + each * many
        self.rows.append((length, at, at + each * many, each, first, offset))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                each = self.capacity // length
                many = -(-count // each)
                self.offer(self.capacity, self.open(many), many)
                continue
            room = self.rooms[k]
            first, many = self.free[room].pop()
            if not self.free[room]:
                del self.free[room], self.rooms[k]
            each = min(room // length, count)
            used = min(many, count // each)
            self.put(length, each, first, used, self.capacity - room)
            self.offer(room - each * length, first, used)
            self.offer(room, first + used, many - used)
            count -= each * used


def best_set(lengths: dict[int, int], room: int) -> dict[int, int]:
    """How many of which lengths fill ``room`` best together; bit x of a number says that x is a sum."""
    sums, steps, within = [1], [], (2 << room) - 1
    for s in sorted((s for s, n in lengths.items() if n and s <= room), reverse=True):
        n, pack = min(lengths[s], room // s), 1
        while n and not sums[-1] >> room:
            take = min(pack, n)
            steps.append((s, take))
            sums.append((sums[-1] | sums[-1] << s * take) & within)
            n, pack = n - take, 2 * pack
    left, found = sums[-1].bit_length() - 1, {}
    for k in range(len(steps), 0, -1):
        if not sums[k - 1] >> left & 1:
            s, take = steps[k - 1]
            found[s] = found.get(s, 0) + take
            left -= s * take
    return found


def _put_set(plan: _Plan, rest: dict[int, int], found: dict[int, int], room: int, first: int, times: int) -> None:
    """Put one set into each of ``times`` sequences that have ``room``."""
    for s, n in found.items():
        plan.put(s, n, first, times, plan.capacity - room)
        rest[s] -= n * times
        room -= s * n
    plan.offer(room, first, times)


def _complete(plan: _Plan, rest: dict[int, int], large: int) -> None:
    """Best sets for the free room, then for sequences opened with each length above ``large``.

    Every step uses up a length (but for a few pieces) or a run, so the steps don't grow with the pieces.
    """
    freed, plan.free, plan.rooms = plan.free, {}, []
    for room in sorted(freed, reverse=True):
        for first, many in freed[room]:
            while many and (found := best_set(rest, room)):
                times = min([many, *(rest[s] // n for s, n in found.items())])
                _put_set(plan, rest, found, room, first, times)
                first, many = first + times, many - times
            plan.offer(room, first, many)
    for s in sorted((s for s in rest if s > large), reverse=True):
        while rest[s]:
            found = best_set(rest | {s: rest[s] - 1}, plan.capacity - s)
            found = {s: 1 + found.pop(s, 0)} | found
            times = min(rest[t] // n for t, n in found.items())
            _put_set(plan, rest, found, plan.capacity, plan.open(times), times)


def plan_lengths(lengths: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    """Number of sequences, and rows (length, first rank, rank after, each, first sequence, offset).

    The best of WAYS; one that needs no more sequences than the tokens fill ends the search.
    """
    large = [(s, n) for s, n in sorted(lengths.items(), reverse=True) if s > capacity // LARGE]
    total = sum(n for _, n in large)
    share = max(1, -(-total // groups))
    queues: list[list[tuple[int, int]]] = []  # of each group, its longest first: length, how many
    held = share
    for s, n in large:
        while n:
            if held == share:
                queues.append([])
                held = 0
            take = min(n, share - held)
            queues[-1].append((s, take))
            held, n = held + take, n - take
    merged: dict[int, list[tuple[int, int]]] = {}
    for q in queues:
        merged.setdefault(q[0][0], []).extend(q)
    sizes = sorted(merged, reverse=True)
    chosen = configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity)
    fewest, best = -(-sum(s * n for s, n in lengths.items()) // capacity), None
    for left_open, sets in WAYS:
        plan, pools = _Plan(capacity), [[[*x] for x in merged[s]] for s in sizes]
        for counts, times in chosen:
            slots = [g for g, c in enumerate(counts) for _ in range(c)]
            _substitute(plan, pools, slots[: len(slots) - left_open], plan.open(times), times)
        rest = {s: n for s, n in lengths.items() if s <= capacity // LARGE}
        for s, n in (x for p in pools for x in p):
            rest[s] = rest.get(s, 0) + n
        if sets:
            _complete(plan, rest, capacity // LARGE)
        for s in sorted(rest, reverse=True):
            plan.best_fit(s, rest[s])
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= fewest:
            break
    return best.sequences, best.rows


def _substitute(plan: _Plan, pools: list[list[list[int]]], slots: list[int], first: int, times: int) -> None:
    """Fill ``times`` sequences with the actual lengths of the slots' groups, as runs."""
    runs = [(first, times, 0)]  # first sequence, how many, used
    for g in slots:
        after = []
        for start, many, used in runs:
            while many:
                s, n = pools[g][-1]
                take = min(many, n)
                plan.put(s, 1, start, take, used)
                after.append((start, take, used + s))
                start, many = start + take, many - take
                pools[g][-1][1] -= take
                if not pools[g][-1][1]:
                    pools[g].pop()
        runs = after
    for start, many, used in runs:
        plan.offer(plan.capacity - used, start, many)


def _ranked(pieces: DataFrame) -> DataFrame:
    """Add rank: 0.. among the pieces of equal length."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))  # at most capacity rows
    parts = counts.select("length", F.ceil(F.col("n") / RANK_ROWS).cast("int").alias("parts"))
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int")).drop("parts")
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("rows"))  # capacity + rows / RANK_ROWS rows
    starts = sizes.selectExpr("length", "part", "sum(rows) OVER (PARTITION BY length ORDER BY part) - rows AS first_rank")
    numbered = dealt.selectExpr("*", "row_number() OVER (PARTITION BY length, part ORDER BY doc_id, piece, ids_crc32) AS nth")
    return numbered.join(F.broadcast(starts), ["length", "part"]).withColumn("rank", F.expr("first_rank + nth - 1")).drop("part", "first_rank", "nth")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, ids_crc32, length and more)."""
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    _, rows = plan_lengths(lengths, capacity)
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch.pop("rank").to_numpy(np.int64)
            row = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - row[:, 1]
            yield batch.assign(sequence_id=row[:, 4] + nth // row[:, 3], offset=row[:, 5] + nth % row[:, 3] * length)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    ranked = _ranked(pieces).select(*pieces.columns, "rank")
    return ranked.mapInPandas(place, fields + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, capacity: int = CAPACITY, closing: int = 1, with_ids: bool = False) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    path = vocabulary_path or vocabulary("word_bpe_49k.json")
    return pack(save(tokenised_pieces(docs, id_col, text_col, path, capacity, closing, with_ids), "pieces"), capacity)


def op6_linear_grouping(spark, sf_dir: str) -> DataFrame:
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
