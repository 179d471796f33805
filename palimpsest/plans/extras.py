"""Queries of the whole engine and of texts whose JSON form SQL cannot match."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from ..operators import engine, store
from . import tables
from .registry import query
from .search import probe_vector

T = tables


@query("eng01_rfn01_qry11_pipeline")
def eng01(spark, sf_dir):
    vector = probe_vector(spark, sf_dir)
    e = engine.Engine(spark, T.chunks(spark, sf_dir), lambda q: vector, index=T.text_index(spark, sf_dir))
    answer = e.ask("how to fix the queion error in main.py")
    row = (answer.analysis["intent"], len(answer.results), answer.evaluation["relevance"], answer.refined, answer.synthesis["primary_content"])
    return spark.createDataFrame([row], "intent string, n int, relevance double, refined boolean, primary_content string")


@query("qry13_question_vector")
def qry13(spark, sf_dir):
    """The vectors of all questions, through the same batches as chunks; blank ones have none."""
    asked = T.questions(spark, sf_dir).select(F.col("qid").cast("string").alias("id"), F.col("question").alias("content"))
    vectors = asked.mapInPandas(store.embed_batches(store.hashed_vectors(64)), "id string, vector array<float>")
    return vectors.select(F.col("id").cast("int").alias("qid"), "vector")


@query("prj19_fallback_identity", """SELECT doc_id, sha256('{"chunk_type": "turn", "content": "' || lang || '", "session_id": "s", "source_file": "f", "source_line": ' || doc_id || '}') AS id FROM documents""")
def prj19(spark, sf_dir):
    """Sorted keys with spaces after colons and commas, as JSON writers in Python give them."""

    @F.pandas_udf(TT.StringType())
    def identity(kind: pd.Series, content: pd.Series, line: pd.Series) -> pd.Series:
        rows = zip(kind, content, line, strict=True)
        return pd.Series([hashlib.sha256(json.dumps({"source_file": "f", "source_line": int(n), "chunk_type": k, "session_id": "s", "content": c}, sort_keys=True).encode()).hexdigest() for k, c, n in rows])

    return T.table(spark, sf_dir, "documents").select("doc_id", identity(F.lit("turn"), "lang", "doc_id").alias("id"))


_CALLS = [(0, '[{"name":"edit_file","args":{"file_path":"a§.py"}},{"name":"run","args":{"command":"touch b§.txt"}},{"name":"view","args":{"path":"c.md"}}]'), (1, "[]")]


@query("str15_str16_tool_operations", T.expected_sql("file_path, operation", [(0, "a§.py", "edit"), (0, "b§.txt", "write"), (0, "c.md", "write")], 2, "i"))
def str16(spark, sf_dir):
    from ..sources.tools import tool_operations

    rows = T.varied(spark, sf_dir, "i, calls", _CALLS)
    return rows.select("i", F.inline(tool_operations(F.col("calls")))).select("i", "file_path", "operation")


_CALL_TEXT = '{"name":"edit_file","args":"{\\"file_path\\":\\"a§.py\\"}"}\n{"name":"run","args":"{\\"command\\":\\"touch b§.txt\\"}"}\n{"name":"view","args":"{\\"path\\":\\"c.md\\"}"}'


@query("prj10_tool_call_text", T.expected_sql("text", [(0, _CALL_TEXT), (1, "")], 2, "i"))
def prj10(spark, sf_dir):
    calls = F.from_json("calls", "array<struct<name: string, args: string>>")
    return T.varied(spark, sf_dir, "i, calls", _CALLS).select("i", F.array_join(F.transform(calls, lambda c: F.to_json(c)), "\n").alias("text"))


_CATALOG = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"], "pages": ["page_id", "url", "html"]}


@query("src20_catalog", " UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS column_name, count({c}) AS filled FROM {t}" for t, cs in _CATALOG.items() for c in cs))
def src20(spark, sf_dir):
    """The columns that the catalog tells of each table, and how many rows have them; a table that is absent has none."""
    out = []
    for name in _CATALOG:
        view = f"palimpsest_catalog_{name}"
        T.table(spark, sf_dir, name).createOrReplaceTempView(view)
        columns = [c.name for c in spark.catalog.listColumns(view)] if spark.catalog.tableExists(view) else []
        counts = spark.table(view).agg(*[F.count(c).alias(c) for c in columns])
        out.append(counts.select(F.lit(name).alias("name"), F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', {c}" for c in columns) + ") AS (column_name, filled)")))
    if spark.catalog.tableExists("palimpsest_absent"):
        raise ValueError("an absent table is in the catalog")
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("snk16_inverted_index", f"WITH {T.CHUNKS_SQL}, t AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\\pL\\pN_]+')) AS token FROM chunks) SELECT token, count(DISTINCT id) AS documents, count(*) AS uses FROM t GROUP BY 1")
def snk16(spark, sf_dir):
    return T.text_index(spark, sf_dir).postings().groupBy("token").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("uses"))
