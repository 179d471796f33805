"""Product codes for vectors, found exactly under segment-mean lower bounds.

Every component becomes an integer and every vector is cut into equal consecutive parts.
Each position has a codebook, which starts as that part of the first vectors and
is moved ``rounds`` times to the means of the parts assigned to each entry.

The nearest entry of a part is searched from coarse to fine. A block of L components
with sum s differs from one with sum c by at least (s - c)^2 / L, and what the
blocks' means leave over differs by at least the difference of its norms. So

    |x - y|^2 >= sum over blocks (s - c)^2 / L + (|rest of x| - |rest of y|)^2.

The first bound takes the whole part as one block; the entry with the least
bound gives a distance that is reached, and entries beyond it are dropped. The next
levels halve the blocks and drop more. Norms are floating-point numbers, so bounds
are made smaller by more than their rounding: no nearest entry is lost. Survivors
receive exact integer distances; ties go to the lower index.

One pass over the vectors for each round and one for the codes. Tasks send sums of
their parts, one row for each entry component at most, so shuffles don't grow with
the rows; the codebooks (parts x entries, a fixed number) are with the driver
and travel in the tasks' function. Passes read the source again: nothing is cached, and a
lost executor costs the tasks at hand.

Defined results: rows whose vector is null or holds null or non-finite components
have no code and no part in anything. Shorter vectors, empty ones included, end
in zeros; the width is that of the longest vector, raised to a multiple of the parts.
Components are limited to a magnitude whose distances fit in a long (2^27 at 64
components). A null id counts as the largest; of rows with equal ids the one with the
smaller vector comes first. Each repeated row has its own code. With fewer
vectors than entries the codebooks have fewer entries. An empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import join_groups, save
from .vectors import distance_limit, numbered, whole_numbers, width_of

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Bounds are made smaller by this share of the norms, far more than rounding takes.
SLACK = 1e-7
#: Parts whose bounds are held at once.
AT_ONCE = 4096


def levels_of(length: int) -> list[np.ndarray]:
    """Where blocks begin: one block, two, four, as long as blocks have two components or more."""
    out, blocks = [], 1
    while 2 * blocks <= length:
        out.append(np.arange(blocks) * length // blocks)
        blocks *= 2
    return out


class Bounded:
    """Entries of one codebook with their block sums and residual norms at each level."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.levels = entries, levels_of(entries.shape[1])
        self.norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.sketches = [self._sketch(entries, at) for at in self.levels]

    @staticmethod
    def _sketch(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block sums, block lengths and the norm of what the means leave over."""
        sums, sizes = np.add.reduceat(x, at, axis=1).astype(np.float64), np.diff(np.append(at, x.shape[1]))
        rest = (x.astype(np.float64) ** 2).sum(1) - (sums**2 / sizes).sum(1)
        return sums, sizes, np.sqrt(np.maximum(rest, 0))

    def exact(self, x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x[rows] - self.entries[at]) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each part, and how many exact distances it took."""
        n, k = len(x), len(self.entries)
        every = np.arange(n)
        rows, at, taken = np.repeat(every, k), np.tile(np.arange(k), n), n
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        best = None
        for level, (sums, sizes, rest) in zip(self.levels, self.sketches, strict=True):
            own, _, own_rest = self._sketch(x, level)
            if best is None:  # all pairs, as a matrix
                bound = ((own[:, None, 0] - sums[None, :, 0]) ** 2) / sizes[0]
                bound += np.maximum(np.abs(own_rest[:, None] - rest[None, :]) - SLACK * (norms[:, None] + self.norms[None, :]), 0) ** 2
                best = self.exact(x, every, bound.argmin(1))
                rows, at = np.nonzero(bound * (1 - SLACK) <= best[:, None])
                continue
            bound = ((own[rows] - sums[at]) ** 2 / sizes).sum(1)
            bound += np.maximum(np.abs(own_rest[rows] - rest[at]) - SLACK * (norms[rows] + self.norms[at]), 0) ** 2
            stay = bound * (1 - SLACK) <= best[rows]
            rows, at = rows[stay], at[stay]
        far = self.exact(x, rows, at)
        begin = np.searchsorted(rows, every)
        least = np.minimum.reduceat(far, begin)
        hit = np.flatnonzero(far == least[rows])
        first = hit[np.searchsorted(rows[hit], every)]  # survivors stand in order of entries
        return at[first], least, taken + len(rows)


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray, width: int, factor: int, limit: int):
    """(batch, integer parts, codes, distances) of each piece of the batches."""
    parts, length = books.shape[0], books.shape[2]
    bounded = [Bounded(b) for b in books]
    for whole in batches:
        for begin in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(begin, AT_ONCE)
            x = whole_numbers(batch.column("vector"), width, factor, limit).reshape(batch.num_rows, parts, length)
            codes, far = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
            for p, b in enumerate(bounded):
                codes[:, p], far[:, p], _ = b.nearest(np.ascontiguousarray(x[:, p]))
            yield batch, x, codes, far


def _sums(books: np.ndarray, width: int, factor: int, limit: int):
    """For each place of the codebooks and the counts after them: the sums of a task."""
    parts, k, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, length), object), np.zeros((parts, k), np.int64)
        for _, x, codes, _ in _assigned(batches, books, width, factor, limit):
            for p in range(parts):
                held = np.zeros((k, length), np.int64)
                np.add.at(held, codes[:, p], x[:, p])  # AT_ONCE components at most: no overflow
                sums[p] += held
                counts[p] += np.bincount(codes[:, p], minlength=k)
        values = np.concatenate([sums.ravel(), counts.ravel().astype(object)])
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([str(v) for v in values[at]], pa.string())], ["at", "value"])

    return run


def _codes(books: np.ndarray, width: int, factor: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, far in _assigned(batches, books, width, factor, limit):
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * codes.shape[1]
            hexes = pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string())
            others = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("id", "vector")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), hexes, pa.array(far.sum(1), pa.int64()), *others], ["id", "code", "error", *[n for n in batch.schema.names if n not in ("id", "vector")]])

    return run


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", others: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> tuple[DataFrame, np.ndarray]:
    """(id, code, error, ``others`` as o0, o1, ...) of every row that counts, and the codebooks (part, entry, component)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = numbered(df, id_col, vector_col, *others)
    width = -(-max(width_of(rows), 1) // parts) * parts
    limit = distance_limit(width)
    first = rows.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = whole_numbers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width, factor, limit)
    books = np.ascontiguousarray(start.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    if len(first):
        for _ in range(rounds):
            told = rows.select("vector").mapInArrow(_sums(books, width, factor, limit), "at long, value string")
            total = dict(told.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
            moved = books.copy()
            for at in np.ndindex(books.shape[:2]):
                used = int(total.get(books.size + np.ravel_multi_index(at, books.shape[:2]), 0))
                if used:
                    moved[at] = [int(total.get(np.ravel_multi_index((*at, i), books.shape), 0)) // used for i in range(books.shape[2])]
            books = moved
    schema = ", ".join(["id long", "code string", "error long", *[f"o{i} {rows.schema[f'o{i}'].dataType.simpleString()}" for i in range(len(others))]])
    if not len(first):
        return rows.sparkSession.createDataFrame([], schema), books
    return rows.mapInArrow(_codes(books, width, factor, limit), schema), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_segment_means(spark, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), others=("label",))
    key = F.concat(F.when(F.col("o0").isNull(), "-").otherwise("="), F.coalesce(F.col("o0").cast("string"), F.lit("")))
    coded = save(coded.select("id", "code", "error", key.alias("label")), "vector-codes")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    summed = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long")
    labels = save(coded.groupBy("label").agg(summed.alias("label_error"), F.count(F.lit(1)).alias("size")), "label-errors")
    told = join_groups(coded, labels, "label", "size", coded.count())
    return told.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


_STEP = """
a{r} AS (SELECT id, p, min({{'d': d, 'e': e}}) AS m FROM (
    SELECT x.id, x.p, e, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c{r}.v[i]) * (x.v[i] - c{r}.v[i]))) AS d FROM x JOIN c{r} USING (p)) GROUP BY id, p)"""
_MOVE = """,
s{r} AS (SELECT p, m.e AS e, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT p, m, v, unnest(range(1, len(v) + 1)) AS i FROM a{r} JOIN x USING (id, p)) GROUP BY ALL),
c{z} AS (SELECT c{r}.p, c{r}.e, coalesce(w.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY p, e) w ON w.p = c{r}.p AND w.e = c{r}.e),"""
OP11_SQL = (
    """
WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS u
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT id, p, u[p * len(u) // 16 + 1 : (p + 1) * len(u) // 16] AS v FROM (SELECT *, unnest(range(16)) AS p FROM k)),
c0 AS (SELECT p, id - 1 AS e, v FROM x WHERE id <= 64),"""
    + "".join(_STEP.format(r=r) + (_MOVE.format(r=r, z=r + 1) if r < ROUNDS else "") for r in range(ROUNDS + 1))
    + f""",
b AS (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) AS books FROM (SELECT p, e, unnest(range(1, len(v) + 1)) AS i, CAST(unnest(v) AS VARCHAR) AS y FROM c{ROUNDS})),
t AS (SELECT id, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM k JOIN t USING (id), b
"""
)
