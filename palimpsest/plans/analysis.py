"""Question analysis, evaluation of results, synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import analyze, evaluate, search, synthesize
from . import tables
from .registry import query, text, texts
from .search import HYBRID_SQL, QUESTION, hybrid, probe_vector


def _one_of(words: list[str]) -> str:
    return "\\b(?:" + "|".join(analyze.escaped(w) for w in words) + ")\\b"


_TECH = {t: _one_of(k) for t, k in fixed.TECHNOLOGIES.items()}
_TECH_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, {text(p)}) THEN {text(t)} END" for t, p in _TECH.items()) + "]::VARCHAR[], lambda x: x IS NOT NULL)"
_COUNTS = ", ".join(f"({' + '.join(f'CAST(regexp_matches(q, {text(p)}) AS INT)' for p in ps)}) AS n_{i}" for i, ps in fixed.INTENT_PATTERNS.items())
_MOST = "greatest(" + ", ".join(f"n_{i}" for i in fixed.INTENT_PATTERNS) + ")"
_INTENT = f"CASE WHEN most = 0 THEN '{fixed.DEFAULT_INTENT}' WHEN n_how_to = most AND n_problem_solving = most AND regexp_matches(q, {text(fixed.PROBLEM_WORDS)}) THEN 'problem_solving' " + " ".join(f"WHEN n_{i} = most THEN '{i}'" for i in fixed.INTENT_PATTERNS) + " END"
_PATTERNS = "CASE intent " + " ".join(f"WHEN '{i}' THEN {len(p)}" for i, p in fixed.INTENT_PATTERNS.items()) + " END"
_TECH_WORDS = "flatten([" + ", ".join(f"CASE WHEN list_contains(techs, {text(t)}) THEN {texts([k.lower() for k in ks])} ELSE []::VARCHAR[] END" for t, ks in fixed.TECHNOLOGIES.items()) + "])"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_ANY_END = "(" + " OR ".join(f"ends_with({{0}}, '{e}')" for e in fixed.FILE_EXTENSIONS) + ")"
_ANY_IN = "(" + " OR ".join(f"contains({{0}}, '{e}')" for e in fixed.FILE_EXTENSIONS) + ")"
_FOUND = "flatten([{}])".format(", ".join(f"list_transform(regexp_extract_all(question, '(?i)\\b{w}\\s+\\w+\\.\\w+\\b'), lambda m: list_extract(regexp_split_to_array(m, '\\s+'), -1))" for w in ("file", "in", "to")))

ANALYSIS_SQL = f"""{tables.QUESTIONS_SQL},
a0 AS (SELECT qid, question, trim(lower(question)) AS q FROM questions),
a1 AS (SELECT *, {_TECH_LIST} AS techs, {_COUNTS} FROM a0),
a2 AS (SELECT *, {_MOST} AS most FROM a1),
a3 AS (SELECT *, {_INTENT} AS intent FROM a2),
a4 AS (SELECT *, CASE WHEN most = 0 THEN 0.3 ELSE least(1.0, 0.4 + most / CAST({_PATTERNS} AS DOUBLE) * 0.6) END AS sure, {_TECH_WORDS} AS tech_words,
       list_filter(regexp_extract_all(regexp_replace(q, '[^\\x00-\\x7F\\pP\\pS\\pZ\\pC]', 'zqz', 'g'), '\\b[a-zA-Z][a-zA-Z0-9_-]*\\b'), lambda w: NOT contains(w, 'zqz')) AS ws,
       list_transform(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> ''), lambda w: rtrim(w, '.,;:!?')) AS fw FROM a3),
a5 AS (SELECT *, list_filter(ws, lambda w: NOT list_contains(tech_words, w) AND (list_contains({texts(fixed.SHORT_TERMS)}, w) OR (NOT list_contains({texts(fixed.STOP_WORDS)}, w) AND length(w) > 2))) AS kw,
       list_filter(fw, lambda w: {_ANY_END.format('w')} OR ((contains(w, '/') OR contains(w, chr(92))) AND {_ANY_IN.format('w')})) AS f1, {_FOUND} AS f2 FROM a4),
a6 AS (SELECT *, {_DISTINCT.format('kw')}[1:10] AS terms, list_filter({_DISTINCT.format('f2')}, lambda x: {_ANY_END.format('x')} AND NOT list_contains(f1, x)) AS f3 FROM a5),
analysis AS (SELECT qid, question, q, CASE WHEN q = '' THEN '{fixed.DEFAULT_INTENT}' ELSE intent END AS intent, sure, techs, terms, list_concat(f1, f3) AS files,
       len(f1) + len(f3) > 0 OR regexp_matches(question, '(?i)\\bfile\\s*(change|edit|modif)') AS about_files,
       CASE WHEN q = '' THEN 0.0 ELSE least(1.0, sure * 0.4 + CASE WHEN len(techs) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(terms) >= 2 THEN 0.2 WHEN len(terms) = 1 THEN 0.1 ELSE 0 END
            + CASE WHEN intent <> '{fixed.DEFAULT_INTENT}' THEN 0.2 ELSE 0 END) END AS confidence FROM a6)"""


def _analysis(spark, sf_dir):
    return analyze.analysis(tables.questions(spark, sf_dir))


@query("anl01_analyze", f"WITH {ANALYSIS_SQL} SELECT qid, intent, array_to_string(techs, ',') AS techs, array_to_string(terms, ',') AS terms, array_to_string(files, ',') AS files, about_files, round(confidence, 9) AS confidence FROM analysis")
def anl01(spark, sf_dir):
    return _analysis(spark, sf_dir).select("qid", "intent", *[F.array_join(c, ",").alias(c) for c in ("techs", "terms", "files")], "about_files", F.round("confidence", 9).alias("confidence"))


@query("str25_intent", f"WITH {ANALYSIS_SQL} SELECT qid, intent, round(CASE WHEN q = '' THEN 0.3 ELSE sure END, 9) AS sure FROM analysis")
def str25(spark, sf_dir):
    return _analysis(spark, sf_dir).select("qid", "intent", F.round("sure", 9).alias("sure"))


@query("str26_intent_patterns", "WITH " + tables.QUESTIONS_SQL + ", p(intent, ord, pattern) AS (VALUES " + ", ".join(f"('{i}', {k}, {text(p)})" for i, ps in fixed.INTENT_PATTERNS.items() for k, p in enumerate(ps)) + ") SELECT qid, intent, CAST(count(*) AS BIGINT) AS n FROM questions, p WHERE regexp_matches(lower(question), pattern) GROUP BY ALL")
def str26(spark, sf_dir):
    return analyze.matching_patterns(tables.questions(spark, sf_dir)).groupBy("qid", "intent").agg(F.count(F.lit(1)).alias("n"))


@query("jon11_str27_technologies", f"WITH {ANALYSIS_SQL} SELECT qid, unnest(techs) AS technology FROM analysis")
def jon11(spark, sf_dir):
    return _analysis(spark, sf_dir).select("qid", F.explode("techs").alias("technology"))


@query("str23_set04_key_terms", f"WITH {ANALYSIS_SQL} SELECT qid, len(terms) AS n, array_to_string(terms, ' ') AS terms FROM analysis")
def str23(spark, sf_dir):
    return _analysis(spark, sf_dir).select("qid", F.size("terms").cast("long").alias("n"), F.array_join("terms", " ").alias("terms"))


@query("str24_file_references", f"WITH {ANALYSIS_SQL} SELECT qid, unnest(files) AS file FROM analysis")
def str24(spark, sf_dir):
    return _analysis(spark, sf_dir).select("qid", F.explode("files").alias("file"))


@query("str28_confidence", f"WITH {ANALYSIS_SQL} SELECT intent, count(*) AS n, round(avg(confidence), 9) AS confidence FROM analysis GROUP BY intent")
def str28(spark, sf_dir):
    return _analysis(spark, sf_dir).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"))


_SUGGEST = """list_filter([CASE WHEN len(techs) = 0 THEN q || ' python' END, CASE WHEN len(techs) = 0 THEN q || ' implementation' END,
 CASE WHEN intent = 'how_to' AND NOT contains(q, 'example') THEN q || ' example' END, CASE WHEN intent = 'how_to' AND NOT contains(q, 'step') THEN q || ' steps' END,
 CASE WHEN intent = 'problem_solving' AND NOT contains(q, 'fix') THEN 'fix ' || q END, CASE WHEN intent = 'problem_solving' AND NOT contains(q, 'solution') THEN q || ' solution' END,
 CASE WHEN intent = 'code_example' AND NOT contains(q, 'code') THEN q || ' code' END], lambda x: x IS NOT NULL)[1:3]"""


@query("str29_refinements", f"WITH {ANALYSIS_SQL} SELECT qid, array_to_string({_SUGGEST}, '|') AS suggestions FROM analysis")
def str29(spark, sf_dir):
    return _analysis(spark, sf_dir).select("qid", F.array_join(analyze.refinements(), "|").alias("suggestions"))


# --- evaluation of the hybrid results for one question, under the analysis of each ---

_CUES = "CASE intent " + " ".join(f"WHEN '{i}' THEN least(1.0, ({' + '.join(f'CAST(contains(lower(content), {text(c)}) AS INT)' for c in cues)}) / {by}.0)" for i, (cues, by) in fixed.INTENT_CUES.items()) + " ELSE 0.5 END"
SCORED_SQL = f"""scored AS (SELECT a.qid, a.intent, a.techs, a.confidence AS analysis_confidence, r.*, list_distinct(regexp_extract_all(a.q, '[\\pL\\pN_]+')) AS qt,
  list_distinct(regexp_extract_all(lower(content), '[\\pL\\pN_]+')) AS ct FROM analysis a, results r WHERE a.q <> ''),
marks AS (SELECT *, least(1.0, (1 - least(1.0, greatest(0.0, score))) * 0.4 + CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / CAST(len(qt) AS DOUBLE) * 0.3 ELSE 0 END
  + CASE WHEN len(list_filter(techs, lambda t: contains(lower(content), t))) > 0 THEN 0.1 ELSE 0 END + ({_CUES}) * 0.2
  + CASE WHEN intent = 'file_history' THEN CASE WHEN chunk_type = 'file_change' THEN 0.1 ELSE 0 END WHEN chunk_type = 'turn' THEN 0.05 ELSE 0 END) AS mark,
  row_number() OVER (PARTITION BY qid ORDER BY score, id) - 1 AS nth FROM scored)"""
_EVAL_SQL = f"""WITH {ANALYSIS_SQL}, {HYBRID_SQL}, {SCORED_SQL},
e AS (SELECT qid, any_value(intent) AS intent, any_value(techs) AS techs, count(*) AS n, sum(mark / (nth + 1)) / sum(1.0 / (nth + 1)) AS relevance, avg(mark) AS mean, max(mark) AS best,
  least(1.0, least(1.0, count(*) / 3.0) * 0.3 + avg(CASE WHEN mark >= 0.5 THEN 1.0 ELSE 0 END) * 0.5 + CASE WHEN count(*) > 1 THEN 1.0 - least(1.0, var_pop(mark) * 2) ELSE 0.5 END * 0.2) AS complete,
  any_value(analysis_confidence) AS ac, bool_or(contains(content, '```')) AS code, bool_or(chunk_type = 'file_change') AS changes, string_agg(lower(content), ' ' ORDER BY score, id) AS every FROM marks GROUP BY qid)"""


def _marks(spark, sf_dir):
    return evaluate.marked(_analysis(spark, sf_dir).where("q <> ''"), hybrid(spark, sf_dir))


@query("mth06_mth07_result_scores", f"WITH {ANALYSIS_SQL}, {HYBRID_SQL}, {SCORED_SQL} SELECT qid, id, round(mark, 9) AS mark FROM marks")
def mth06(spark, sf_dir):
    return _marks(spark, sf_dir).select("qid", "id", F.round("mark", 9).alias("mark"))


@query("set03_term_overlap", f"WITH {ANALYSIS_SQL}, {HYBRID_SQL}, {SCORED_SQL} SELECT qid, id, CAST(len(list_intersect(qt, ct)) AS BIGINT) AS shared FROM scored")
def set03(spark, sf_dir):
    return _marks(spark, sf_dir).select("qid", "id", "shared")


@query("evl01_agg12_agg13_agg14_evaluate", _EVAL_SQL + " SELECT qid, n, round(relevance, 9) AS relevance, round(complete, 9) AS completeness, round(least(1.0, least(1.0, n / 5.0) * 0.3 + mean * 0.4 + ac * 0.3), 9) AS confidence, relevance < 0.5 OR complete < 0.4 AS needs_refinement FROM e")
def evl01(spark, sf_dir):
    e = evaluate.evaluation(_marks(spark, sf_dir))
    return e.select("qid", "n", *[F.round(c, 9).alias(c) for c in ("relevance", "completeness", "confidence")], "needs_refinement")


@query("evl02_suggestions", _EVAL_SQL + """ SELECT qid, CASE WHEN best < 0.3 THEN 'Try more general search terms' ELSE array_to_string(list_filter([CASE WHEN mean < 0.5 THEN 'Add more specific keywords' END,
 CASE WHEN intent = 'code_example' AND NOT code THEN 'Add ''example'' or ''code'' to query' END, CASE WHEN intent = 'how_to' THEN 'Try adding ''steps'' or ''guide''' END,
 CASE WHEN intent = 'file_history' AND NOT changes THEN 'Use search_file_changes tool instead' END], lambda x: x IS NOT NULL)[1:3], '|') END AS suggestions,
 CASE WHEN best < 0.3 THEN 'No closely matching content found' ELSE array_to_string(list_concat(list_filter([CASE WHEN intent = 'code_example' AND NOT code THEN 'Code examples' END,
 CASE WHEN intent = 'file_history' AND NOT changes THEN 'File change history' END], lambda x: x IS NOT NULL), list_transform(list_filter(techs, lambda t: NOT contains(every, t)), lambda t: 'Information about ' || t))[1:3], '|') END AS missing FROM e""")
def evl02(spark, sf_dir):
    return evaluate.evaluation(_marks(spark, sf_dir)).select("qid", F.array_join("suggestions", "|").alias("suggestions"), F.array_join("missing", "|").alias("missing"))


# --- synthesis ---


@query("syn01_synthesize")
def syn01(spark, sf_dir):
    results = _analysis(spark, sf_dir).select("qid", "techs", "terms").crossJoin(F.broadcast(hybrid(spark, sf_dir)))  # ten results
    return synthesize.synthesized(results)


@query("syn02_similar_results")
def syn02(spark, sf_dir):
    best = search.hybrid_search(tables.chunks(spark, sf_dir), QUESTION, probe_vector(spark, sf_dir), fixed.MOST_RESULTS, index=tables.text_index(spark, sf_dir))
    results = best.select(F.lit(0).alias("qid"), "id", "content", "score", "chunk_type", "session_id", "file_path", "operation", F.array().cast("array<string>").alias("techs"), F.array().cast("array<string>").alias("terms"))
    return synthesize.synthesized(results).select("qid", "deduplication_count", "n_unique")


_DEDUP = f"WITH {tables.CHUNKS_SQL}, k AS (SELECT id, doc_id, session_id, md5(content) AS h FROM chunks)"


@query("syn02_exact_dedup", _DEDUP + " SELECT id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS nth FROM k) WHERE nth = 1")
def syn02_exact(spark, sf_dir):
    keyed = tables.chunks(spark, sf_dir).select("id", "doc_id", F.md5("content").alias("h"))
    return synthesize.first_of(keyed, ["h"], ["doc_id"]).select("id", "doc_id")


@query("win08_first_change_of_file", f"WITH {tables.CHUNKS_SQL} SELECT file_path, id, operation FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY doc_id) AS nth FROM chunks WHERE chunk_type = 'file_change') WHERE nth = 1")
def win08(spark, sf_dir):
    changes = tables.chunks(spark, sf_dir).where("chunk_type = 'file_change'").select("file_path", "id", "operation", "doc_id")
    return synthesize.first_of(changes, ["file_path"], ["doc_id"]).select("file_path", "id", "operation")


_POINT = "0.3 + CASE WHEN " + " OR ".join(f"contains(l, '{w}')" for w in fixed.ACTION_WORDS) + " THEN 0.2 ELSE 0 END + CASE WHEN " + " OR ".join(f"contains(l, '{w}')" for w in fixed.EXPLAIN_WORDS) + " THEN 0.2 ELSE 0 END"
_SENTENCES = "SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')) AS s FROM documents"


@query("mth05_sentence_scores", f"WITH x AS ({_SENTENCES}), y AS (SELECT doc_id, s, lower(s) AS l FROM x WHERE length(s) BETWEEN 20 AND 300) SELECT doc_id, count(*) AS n, round(sum({_POINT}), 6) AS points FROM y GROUP BY doc_id")
def mth05(spark, sf_dir):
    from ..functions import text as tx

    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s")).where(F.length("s").between(20, 300))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(synthesize.sentence_score(F.col("s"))), 6).alias("points"))


@query("top07_sources_by_relevance", f"WITH {HYBRID_SQL} SELECT id, round(greatest(0, least(1, 1 - score)), 9) AS relevance, row_number() OVER (ORDER BY score, id) AS nth FROM results")
def top07(spark, sf_dir):
    return synthesize.sources(hybrid(spark, sf_dir)).select("id", F.round("relevance", 9).alias("relevance"), "nth")


@query("top10_best_result", f"WITH {HYBRID_SQL} SELECT id AS best FROM results ORDER BY score, id LIMIT 1")
def top10(spark, sf_dir):
    return hybrid(spark, sf_dir).agg(F.min_by("id", F.struct(F.coalesce("score", F.lit(float("inf"))), "id")).alias("best"))
