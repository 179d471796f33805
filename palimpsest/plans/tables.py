"""The engine's tables as views over the given Parquet tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.textindex import TextIndex
from ..operators.vectorindex import VectorIndex
from ..paths import scratch, state_of


_SCHEMAS: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its columns are looked up once for each state of its files."""
    path = f"{sf_dir}/{name}.parquet"
    key = (path, state_of(spark, path))
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Documents as chunks; the vector is null where a document has no embedding.

    Without ``vectors`` there is no such column, and texts are not shuffled for a join (a
    document has one embedding at most).
    """
    documents = table(spark, sf_dir, "documents")
    if vectors:
        e = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", "embedding AS vector")
        documents = documents.join(e, "doc_id", "left")
    return documents.selectExpr(
        "doc_id",
        "substring(sha2(concat('chunk-', doc_id), 256), 1, 16) AS id",
        "text AS content", *(["vector"] if vectors else []),
        "CASE WHEN doc_id % 4 < 2 THEN 'turn' WHEN doc_id % 4 = 2 THEN 'file_change' ELSE 'summary' END AS chunk_type",
        "concat('s', doc_id % 50) AS session_id",
        "concat('/work/', source) AS project_path", "source AS project_name",
        f"timestamp_micros((doc_id + {1767225600 // 60}) * 60000000) AS timestamp",
        "CASE WHEN doc_id % 4 = 2 THEN concat('/work/', source, '/file_', doc_id % 7, '.py') END AS file_path",
        "CASE WHEN doc_id % 4 = 2 THEN CASE WHEN doc_id % 8 = 2 THEN 'edit' ELSE 'write' END END AS operation",
        "concat('/logs/s', doc_id % 50, '.jsonl') AS source_file",
        "doc_id AS source_line",
        "concat('machine-', doc_id % 3) AS machine_id",
    )


CHUNKS_SQL = """chunks AS (
  SELECT d.doc_id, substr(sha256('chunk-' || d.doc_id), 1, 16) AS id, d.text AS content, e.embedding AS vector,
    CASE WHEN d.doc_id % 4 < 2 THEN 'turn' WHEN d.doc_id % 4 = 2 THEN 'file_change' ELSE 'summary' END AS chunk_type,
    's' || (d.doc_id % 50) AS session_id, '/work/' || d.source AS project_path, d.source AS project_name,
    TIMESTAMP '2026-01-01 00:00:00' + to_minutes(d.doc_id) AS timestamp,
    CASE WHEN d.doc_id % 4 = 2 THEN '/work/' || d.source || '/file_' || (d.doc_id % 7) || '.py' END AS file_path,
    CASE WHEN d.doc_id % 4 = 2 THEN CASE WHEN d.doc_id % 8 = 2 THEN 'edit' ELSE 'write' END END AS operation,
    '/logs/s' || (d.doc_id % 50) || '.jsonl' AS source_file, d.doc_id AS source_line, 'machine-' || (d.doc_id % 3) AS machine_id
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


_INDEXES: dict = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of the chunks; built once for each state of their table."""
    path = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, state_of(spark, path))
    if key not in _INDEXES or not _INDEXES[key].exists():
        _INDEXES[key] = TextIndex(spark, scratch(spark, "text-index")).build(chunks(spark, sf_dir, vectors=False))
    return _INDEXES[key]


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored index of the chunks' vectors; built once for each state of their tables."""
    paths = [f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings")]
    key = (spark.sparkContext.applicationId, *paths, *[state_of(spark, p) for p in paths])
    if key not in _INDEXES or not _INDEXES[key].exists():
        _INDEXES[key] = VectorIndex(spark, scratch(spark, "vector-index")).build(chunks(spark, sf_dir))
    return _INDEXES[key]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows as log entries: session, line (from 1), role, text."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), (F.col("turn") + 1).cast("long").alias("line"), "role", "text",
        F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project_name"),
        F.timestamp_micros((F.col("conv_id") * 1000 + F.col("turn") + F.lit(1767225600)) * 1_000_000).alias("ts"),
    )


ENTRIES_SQL = """entries AS (
  SELECT 'c' || conv_id AS session_id, CAST(turn + 1 AS BIGINT) AS line, role, text, 'p' || (conv_id % 5) AS project_name,
    TIMESTAMP '2026-01-01 00:00:00' + to_seconds(conv_id * 1000 + turn) AS ts FROM conversations)"""

#: A batch of questions that meets every intent, several technologies and file references.
QUESTIONS = [
    "How to configure django with docker", "steps to set up kubernetes on aws", "python error traceback in main.py", "fix the bug in auth.js please",
    "why is the redis cache not working", "show me how to use asyncio", "code for a rust tokio server example", "sample snippet for react hooks",
    "api documentation for fastapi parameters", "syntax of the SQL return type", "what did we change in src/app.py", "recent edits to file config.yaml",
    "history of the deployment service", "what happened to utils.py", "last session about terraform", "where were we with the migration",
    "continue the previous discussion", "why did we choose postgresql", "the decision about graphql", "remember when we decided on go mod",
    "what was the reason for the timeout", "use c# now", "embedding vector search with faiss", "the cat sat on the mat", "", "   ",
    "how do i fix this issue", "file changes in README.md", "git rebase or merge the branch?", "UI and DB for the ml ci pipeline", "tutorial guide walkthrough create implement",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say in the conversations, each with one of the openings above before it; blank openings stay blank questions."""
    stems = values(spark, "nth, stem", list(enumerate(QUESTIONS)))
    said = table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr("cast(conv_id * 1000 + turn AS int) AS qid", "text", f"(conv_id * 7 + turn) % {len(QUESTIONS)} AS nth")
    return said.join(F.broadcast(stems), "nth").selectExpr("qid", "CASE WHEN trim(stem) = '' THEN stem ELSE concat(stem, ' ', text) END AS question")


def _spark_text(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


QUESTIONS_SQL = "stems(nth, stem) AS (VALUES " + ", ".join("({}, '{}')".format(i, q.replace("'", "''")) for i, q in enumerate(QUESTIONS)) + f"""),
questions AS (SELECT CAST(conv_id * 1000 + turn AS INTEGER) AS qid, CASE WHEN trim(stem) = '' THEN stem ELSE stem || ' ' || text END AS question FROM conversations JOIN stems ON (conv_id * 7 + turn) % {len(QUESTIONS)} = nth WHERE role = 'user')"""

#: In a template stands for what makes a document's row its own: source and id.
MARK = "§"
_OWN = "coalesce(documents.source, 'none') || '-' || documents.doc_id"


def varied(spark: SparkSession, sf_dir: str, columns: str, rows: list[tuple]) -> DataFrame:
    """A row for every document: the template that its id selects, with the marks replaced. The first column is the document's id."""
    key, *names = columns.split(", ")
    templates = values(spark, ", ".join(["nth", *names]), [(k, *r[1:]) for k, r in enumerate(rows)])
    each = table(spark, sf_dir, "documents").alias("documents").selectExpr(f"doc_id AS {key}", f"doc_id % {len(rows)} AS nth", f"{_OWN} AS own")
    made = [f"replace({c}, '{MARK}', own) AS {c}" if any(isinstance(r[i], str) for r in rows) else c for i, c in enumerate(names, 1)]
    return each.join(F.broadcast(templates), "nth").selectExpr(key, *made)


def varied_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """The same rows as SQL."""
    key, *names = columns.split(", ")
    made = ", ".join(f"replace({name}_t.{c}, '{MARK}', {_OWN}) AS {c}" if any(isinstance(r[i], str) for r in rows) else f"{name}_t.{c}" for i, c in enumerate(names, 1))
    return f"{values_sql(name + '_t', ', '.join(['nth', *names]), [(k, *r[1:]) for k, r in enumerate(rows)])}, {name} AS (SELECT doc_id AS {key}, {made} FROM documents JOIN {name}_t ON doc_id % {len(rows)} = nth)"


def expected_sql(columns: str, rows: list[tuple], templates: int, key: str | None = None) -> str:
    """What every document must give: the rows (number of its template, columns), with the marks replaced; beside them its id as ``key``."""
    names = columns.split(", ")
    made = [f"replace(t.{c}, '{MARK}', {_OWN}) AS {c}" if any(isinstance(r[i], str) for r in rows) else f"t.{c}" for i, c in enumerate(names, 1)]
    return f"WITH {values_sql('t', ', '.join(['nth', *names]), rows)} SELECT {', '.join([*([f'doc_id AS {key}'] if key else []), *made])} FROM documents JOIN t ON doc_id % {templates} = nth"


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table; the same rows are written as SQL by ``values_sql``."""
    def one(v):
        return "NULL" if v is None else _spark_text(v) if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            parts = v.replace("'", "''").split("\n")
            return "('" + "' || chr(10) || '".join(parts) + "')"
        return str(v)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
