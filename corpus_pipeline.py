"""A corpus pipeline: quality rules, exact and near deduplication, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. Between stages the rows are written
as Parquet into the shared folder and read again, so a lost executor costs at
most the stage at hand.

Defined results: null, empty and very long texts, repeated rows and empty tables
pass through the stages as their operators say; columns beyond those of
``documents`` are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, minhash, packing, quality, secrets
from palimpsest.llm._shared import discard, save

#: Identifiers of dropped rows are sent to the scan up to this number, else joined by shuffle.
BROADCAST_DROPPED = 200_000


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_DROPPED else rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    packed = docs.select(F.struct("*").alias("doc"), "text", "lang", "source")
    return quality.adaptive_quality(packed, ["doc"]).where("kept").select("doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    found = save(exact_dedup.exact_dedup(docs, keep="smallest").select("id", "sha", "kept"), "exact-verdicts")
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    repeated = found.groupBy("id", "sha").count().where("count > 1")
    if repeated.isEmpty():
        gone = _few(found.where("NOT kept").select(F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha")))
        return packed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti").select("doc.*")
    stay = found.where("kept").select(F.col("id").alias("stay_id"), F.col("sha").alias("stay_sha"))
    kept = packed.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("sha") == F.col("stay_sha")), "left_semi")
    return kept.dropDuplicates(["id", "sha"]).select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id. A row goes by id and text, not by id alone."""
    found = minhash.near_duplicates(docs, width=5, percent=80, with_sha=True)
    gone = save(found.where("NOT kept").select(F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha")).distinct(), "near-copies")
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    return packed.join(_few(gone), (F.col("id") == F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti").select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; n_chars follows."""
    packed = docs.select(F.struct("*").alias("doc"), "text")
    found = secrets.secret_spans(packed, ["doc"])
    clean = secrets.redact(F.coalesce(F.col("doc.text"), F.lit("")), F.col("spans"))
    some = F.size("spans") > 0
    changed = {"text": F.when(some, clean).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(some, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return found.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document becomes pieces with a place in a sequence."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("secret scan", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Near-duplicate components and tokenised packing have no SQL; tests hold the stages against plain versions, each on what the stage before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = save(stage(spark, before, sf_dir), name.replace(" ", "-"))
        discard(before)  # only what this pipeline wrote itself
    return STAGES[-1][1](spark, docs, sf_dir)
