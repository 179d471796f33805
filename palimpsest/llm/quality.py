"""Quality rules with adaptive thresholds (DataFrame operations only).

1. Base metrics of every whole text, in the row: nothing is exploded or
   shuffled. Repeated three-word windows are found by sorting a text's windows
   (an array sort, n log n) and comparing neighbours, on the words themselves.
2. Each (lang, source) gets a quantile sketch of four ratios over the documents
   that pass the base rules: counts by log-linear bucket (six significant bits, a
   relative error below 1/64). Sketches merge by adding counts, so they combine
   in the tasks and up to coarser groups; they do not depend on the order of rows.
3. The fence of a group is q75 + reach * max(q75 - q25, least spread), and the
   mirror image below for the mean word length. Groups with fewer than
   ``min_rows`` documents use the sketch of their language, and then of the table.
4. Documents are joined with the fences of their group and kept if no ratio is
   outside. The fences are broadcast behind a check of their number.

Defined results: a null text has no words and fails the base rules; null lang
and null source are groups of their own; ties fall inside the fence; repeated rows
each get the same verdict; an empty table gives no rows. Columns carried along
keep their names; the metrics are put beside them under names given here, so
``carry`` must not contain those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bound, col, discard, save, text_or_empty

SPACES = r"[\x20\x09-\x0D]"
METRICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Ratio: numerator, denominator, whether both sides are fenced, least spread (all in millionths).
RATIOS = {
    "symbols": ("n_symbols", "word_chars", False, 10_000),
    "dup_lines": ("n_dup_lines", "n_lines", False, 50_000),
    "repeats": ("n_repeat_words", "n_words", False, 75_000),
    "word_length": ("word_chars", "n_words", True, 400_000),
}
#: Fences are broadcast up to this number of (lang, source) groups, else joined by shuffle.
BROADCAST_GROUPS = 50_000


def _measures(text: Column) -> Column:
    """METRICS of a text as a struct.

    Every array is bound to a lambda variable, so that an optimiser which puts
    this expression into a filter evaluates it once a row there, not once an element.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    plain = F.trim(F.regexp_replace(text, SPACES + "+", " "))

    def windows(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return F.sort_array(F.transform(starts, lambda x, i: F.struct(x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def repeated(s: Column) -> Column:
        """Sorted places of the windows that occur twice or more."""
        return F.sort_array(F.array_compact(F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["i"]))))

    def covered(p: Column) -> Column:
        widths = F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda total, v: total + v.cast("long"))

    def measured(pl: Column, li: Column) -> Column:
        words = F.when(pl == "", F.array().cast("array<string>")).otherwise(F.split(pl, " "))
        return bound(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), (F.length(pl) - F.greatest(F.size(w) - 1, F.lit(0))).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.size(li).cast("long").alias("n_lines"),
            (F.size(li) - F.size(F.array_distinct(li))).cast("long").alias("n_dup_lines"), bound(bound(windows(w), repeated), covered).alias("n_repeat_words")))

    return bound(plain, lambda pl: bound(lines, lambda li: measured(pl, li)))


def with_metrics(rows: DataFrame, text: Column) -> DataFrame:
    """Add METRICS to ``rows``; ``text`` is not null."""
    carried = [col(c) for c in rows.columns]
    return rows.select(*carried, _measures(text).alias("__m")).select(*carried, *[F.col(f"__m.{m}").alias(m) for m in METRICS])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratio(name: str) -> Column:
    top, bottom, _, _ = RATIOS[name]
    return F.expr(f"(1000000 * {top}) div greatest({bottom}, 1)")


def _bucket(v: str) -> str:
    """Smallest value of the log-linear bucket of v: six significant bits."""
    return f"shiftleft(shiftright({v}, greatest(length(bin({v})) - 6, 0)), greatest(length(bin({v})) - 6, 0))"


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: mergeable by adding n."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), ratio(m).alias("v")) for m in RATIOS])
    passing = measured.where(~base_failed()).select("lang", "source", F.inline(values))
    return passing.selectExpr("lang", "source", "metric", f"{_bucket('v')} AS bucket").groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str], reach: float, tag: str) -> DataFrame:
    """A row for each group: its documents and the fences of every ratio."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    up = group.orderBy("bucket")
    ranked = merged.select("*", F.sum("n").over(up).alias("upto"), F.sum("n").over(group).alias("all"))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket")))
    quart = ranked.groupBy(*keys, "metric").agg(F.max("all").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    spread = F.create_map(*[F.lit(x) for m, r in RATIOS.items() for x in (m, r[3])])
    width = F.greatest(F.col("q3") - F.col("q1"), spread[F.col("metric")]) * F.lit(reach)
    bounds = quart.select(*keys, "metric", "rows", (F.col("q3") + width).alias("high"), (F.col("q1") - width).alias("low"))
    pick = lambda c, m: F.max(F.when(F.col("metric") == m, F.col(c)))
    aggs = [pick("high", m).alias(f"{tag}_{m}_high") for m in RATIOS] + [pick("low", m).alias(f"{tag}_{m}_low") for m, r in RATIOS.items() if r[2]]
    return bounds.groupBy(*keys).agg(F.max("rows").alias(f"{tag}_rows"), *aggs)


def adaptive_quality(docs: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = 6.0, min_rows: int = 200) -> DataFrame:
    """``carry`` columns of every row, METRICS, base_failed and kept."""
    named = {c: f"__c{i}" for i, c in enumerate(carry)}
    rows = docs.select(*[col(c).alias(k) for c, k in named.items()], col(lang_col).alias("lang"), col(source_col).alias("source"), text_or_empty(text_col).alias("__text"))
    measured = save(with_metrics(rows, F.col("__text")).drop("__text"), "quality-metrics")
    sketch = save(sketches(measured), "quality-sketches")
    by_source = _fences(sketch, ["lang", "source"], reach, "s")
    by_lang = _fences(sketch, ["lang"], reach, "l").withColumnRenamed("lang", "l_lang")
    overall = _fences(sketch, [], reach, "t")  # no group key: one row
    fences = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left").drop("l_lang").withColumn("one", F.lit(1)).join(F.broadcast(overall.withColumn("one", F.lit(1))), "one", "left")

    def fence(name: str) -> Column:
        return F.when(F.col("s_rows") >= min_rows, F.col(f"s_{name}")).when(F.col("l_rows") >= min_rows, F.col(f"l_{name}")).otherwise(F.col(f"t_{name}"))

    sides = [f"{m}_high" for m in RATIOS] + [f"{m}_low" for m, r in RATIOS.items() if r[2]]
    fences = save(fences.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[fence(x).alias(x) for x in sides]), "quality-fences")
    discard(sketch)
    few = fences.count() <= BROADCAST_GROUPS
    joined = measured.join(F.broadcast(fences) if few else fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    inside = F.lit(True)
    for m, r in RATIOS.items():
        inside &= F.coalesce(ratio(m) <= F.col(f"{m}_high"), F.lit(True))
        if r[2]:
            inside &= F.coalesce(ratio(m) >= F.col(f"{m}_low"), F.lit(True))
    return joined.select(*[F.col(k).alias(c) for c, k in named.items()], *METRICS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def op3_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    found = adaptive_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_fence(keys: str, tag: str) -> str:
    spread = "CASE metric " + " ".join(f"WHEN '{m}' THEN {r[3]}" for m, r in RATIOS.items()) + " END"
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
{tag}_m AS (SELECT {by}metric, bucket, sum(n) AS n FROM sketch GROUP BY {by}metric, bucket),
{tag}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS al FROM {tag}_m),
{tag}_q AS (SELECT {by}metric, max(al) AS n_rows, min(bucket) FILTER (upto * 4 >= al) AS q1, min(bucket) FILTER (upto * 4 >= al * 3) AS q3 FROM {tag}_r GROUP BY {by}metric),
{tag}_b AS (SELECT {by}metric, n_rows, q3 + 6.0 * greatest(q3 - q1, {spread}) AS high, q1 - 6.0 * greatest(q3 - q1, {spread}) AS low FROM {tag}_q),
{tag} AS (SELECT {by}max(n_rows) AS n_rows, {", ".join(f"max(high) FILTER (metric = '{m}') AS {m}_high, max(low) FILTER (metric = '{m}') AS {m}_low" for m in RATIOS)} FROM {tag}_b {group})"""


def _sql_fenced() -> str:
    def side(x: str) -> str:
        return f"CASE WHEN s.n_rows >= 200 THEN s.{x} WHEN l.n_rows >= 200 THEN l.{x} ELSE t.{x} END"

    tests = []
    for m, (top, bottom, both, _) in RATIOS.items():
        v = f"(1000000 * {top}) // greatest({bottom}, 1)"
        tests.append(f"coalesce({v} <= {side(m + '_high')}, true)")
        if both:
            tests.append(f"coalesce({v} >= {side(m + '_low')}, true)")
    return " AND ".join(tests)


OP3_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win),
cov AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep WHERE n > 1) GROUP BY rid),
m AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, (1000000 * {r[0]}) // greatest({r[1]}, 1) AS v FROM f WHERE NOT base_failed" for m, r in RATIOS.items())}),
sketch AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n FROM v GROUP BY ALL),
{_sql_fence("lang, source", "s")},{_sql_fence("lang", "l")},{_sql_fence("", "t")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({_sql_fenced()}) AS kept
FROM f LEFT JOIN s ON f.lang IS NOT DISTINCT FROM s.lang AND f.source IS NOT DISTINCT FROM s.source
LEFT JOIN l ON f.lang IS NOT DISTINCT FROM l.lang LEFT JOIN t ON true
"""
