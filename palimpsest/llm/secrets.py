"""Secret scans with multipart credential linking (DataFrame operations only).

Base secrets stand alone: assignments, access identifiers, long hex strings.
Beyond them a text can hold weak parts of a credential: identifiers (user names,
client ids, mail addresses), other secret-looking values and endpoints. A weak
part is reported only when its complements occur in the same scope:

* an identifier, when a secret (base or weak) does;
* a weak secret, when an identifier (weak, or a base access identifier) does;
* an endpoint, when both do.

Scopes are an interval join: every part is widened by ``reach`` code points on both
sides, and two parts share a scope when their intervals overlap (parts do not
chain). A part needs only one complement of each kind, so the join is a sweep over
the sorted parts of a text: the furthest end of that kind before it and the nearest
start behind it decide. These are running maxima and minima over one text's parts,
linear in their number; no pairs are made.

Positions come from the built-in regular expressions alone: splitting a text by a
pattern gives the gaps between its leftmost non-overlapping matches, and prefix
sums of gap and match lengths give the code points (a doubling scan, n log n).

Defined results: a null text counts as empty and has no spans; weak parts that
overlap a base span are dropped; equal spans of several weak kinds are all
listed, in kind order; repeated rows each get all their spans; an empty table
gives no rows. Carried columns keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import col, save, text_or_empty

KEYWORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts. No group is repeated in any pattern: the regular expressions here recurse on those, and a long text would end the JVM's stack.
IDENTIFIER = r"""(?:[Uu]ser(?:_?[Nn]ame)?|[Ll]ogin|[Aa]ccount|[Cc]lient_?[Ii]d|[Kk]ey_?[Ii]d)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]*[A-Za-z0-9-]"""
WEAK_SECRET = r"""(?:[Pp]wd|[Pp]ass|[Aa]uth|[Cc]redentials?|[Pp]rivate_?[Kk]ey)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}|[Bb]earer\x20+[A-Za-z0-9+/_.=-]{8,}|\b(?=[A-Za-z0-9+/_-]{0,64}[0-9])(?=[A-Za-z0-9+/_-]{0,64}[A-Z])(?=[A-Za-z0-9+/_-]{0,64}[a-z])[A-Za-z0-9+/_-]{20,}"""
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?:[Hh]ost|[Ee]ndpoint|[Ss]erver)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]+"""
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
#: Widening of a part on both sides, in code points.
REACH = 200

#: Linked parts are sent to the rows up to this number of texts that have some, else joined by shuffle.
BROADCAST_LINKED = 100_000

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(a: Column, merge) -> Column:
    """Prefix sums, or other prefix merges, of an int array, by doubling."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(a).cast("long"))) - 1)

    def merged(acc: Column, r: Column) -> Column:
        shift = F.pow(F.lit(2), r).cast("int")
        return F.transform(acc, lambda v, i: F.when(i < shift, v).otherwise(merge(v, F.get(acc, i - shift))))

    return F.aggregate(rounds, a, merged)


def find_spans(text: Column, pattern: str, kind: int, needs: Column, valid: tuple[int, int] | None = None) -> Column:
    """Spans of all matches of ``pattern``; ``needs`` is a cheap necessary condition.

    valid: (group, length): matches whose group is shorter are dropped.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("m")))
    if valid:
        group = F.regexp_extract_all(text, F.lit(pattern), valid[0])
        lengths = F.zip_with(lengths, group, lambda x, v: F.struct(x["g"], x["m"], (F.length(v) >= valid[1]).alias("ok")))

    def place(x: Column) -> Column:
        steps = F.transform(x, lambda v, i: v["g"] + F.coalesce(F.get(x, i - 1)["m"], F.lit(0)))
        return F.transform(F.array(_running(steps, lambda v, w: v + w)), lambda at: F.zip_with(x, at, lambda v, s: F.struct(
            s.alias("start"), F.lit(kind).alias("kind"), (s + v["m"]).alias("end"), (v["ok"] if valid else F.lit(True)).alias("ok"), v["m"].alias("m"))))[0]

    placed = F.transform(F.array(lengths), place)[0]
    kept = F.filter(placed, lambda v: (v["m"] > 0) & F.coalesce(v["ok"], F.lit(False)))
    spans = F.transform(kept, lambda v: F.struct(v["start"], v["kind"], v["end"]))
    return F.when(needs, spans).otherwise(F.array()).cast(SPAN)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, carry: list[str], text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``carry`` columns of every row, ``base`` and ``spans`` (arrays of start, kind, end)."""
    named = {c: f"__c{i}" for i, c in enumerate(carry)}
    t = F.col("__t")
    rows = docs.select(*[col(c).alias(k) for c, k in named.items()], text_or_empty(text_col).alias("__t"))
    sign = t.contains("=") | t.contains(":")
    found = rows.select(
        *named.values(), "__t",
        find_spans(t, ASSIGN, 0, sign & t.rlike(ASSIGN), (2, 6)).alias("assign"),
        find_spans(t, ACCESS, 1, t.contains("AKIA")).alias("access"),
        find_spans(t, HEX, 2, t.rlike(HEX)).alias("hex"),
        find_spans(t, IDENTIFIER, 3, (sign | t.contains("@")) & t.rlike(IDENTIFIER)).alias("identifier"),
        find_spans(t, ENDPOINT, 5, sign & t.rlike(ENDPOINT)).alias("endpoint"),
    )
    named_part = (F.size("access") > 0) | (F.size("identifier") > 0)
    found = found.select(
        F.monotonically_increasing_id().alias("rid"), *named.values(),
        F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        F.concat("identifier", "endpoint", F.when(named_part, find_spans(t, WEAK_SECRET, 4, t.rlike(r"[0-9:=]"))).otherwise(F.array().cast(SPAN))).alias("weak"),
    )
    found = save(found, "secret-parts")
    linked = save(_linked(found.where((F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)), reach), "secret-links")
    joined = found.join(F.broadcast(linked) if linked.count() <= BROADCAST_LINKED else linked, "rid", "left")
    extra = F.coalesce("linked", F.array().cast(SPAN))
    return joined.select(*[F.col(k).alias(c) for c, k in named.items()], "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def _linked(rows: DataFrame, reach: int) -> DataFrame:
    """rid and the weak parts whose complements are in their scope."""
    parts = rows.select("rid", F.inline(F.concat("base", "weak")))
    text = Window.partitionBy("rid")
    before = text.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = text.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)  # a running minimum from the end
    base = F.col("kind") <= 2
    free = parts.select(
        "*",
        (F.coalesce(F.max(F.when(base, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(after) < F.col("end"), F.lit(False))).alias("hidden"),
    ).where(base | ~F.col("hidden"))  # weak parts that overlap a base span are dropped

    def near(*kinds: int) -> Column:
        of = F.col("kind").isin(*kinds)
        gap_before = F.col("start") - F.max(F.when(of, F.col("end"))).over(before)
        gap_after = F.min(F.when(of, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(gap_before <= 2 * reach, F.lit(False)) | F.coalesce(gap_after <= 2 * reach, F.lit(False))

    k = F.col("kind")
    seen = free.select("rid", "start", "kind", "end", near(1, 3).alias("named"), near(0, 2, 4).alias("secret"))
    told = seen.where(((k == 3) & F.col("secret")) | ((k == 4) & F.col("named")) | ((k == 5) & F.col("secret") & F.col("named")))
    return told.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).cast(SPAN).alias("linked"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; spans that touch or overlap become one mark."""

    def rebuilt(s: Column, furthest: Column) -> Column:
        last = lambda i: F.coalesce(F.get(furthest, i - 1), F.lit(0))
        gap = lambda x, i: F.substring(text, last(i) + 1, x["start"] - last(i))
        first = lambda x, i: (i == 0) | (x["start"] > last(i))
        pieces = F.transform(s, lambda x, i: F.when(first(x, i), F.concat(gap(x, i), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(furthest) + 1, F.length(text)))

    ends = lambda s: _running(F.transform(s, lambda x: x["end"]), F.greatest)
    bound = F.transform(F.array(F.array_sort(spans)), lambda s: F.transform(F.array(ends(s)), lambda e: rebuilt(s, e))[0])[0]
    return F.when(F.size(spans) == 0, text).otherwise(bound)


def op8_credential_linking(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )
