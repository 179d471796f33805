"""Question analysis: intent, technologies, key terms, file references, as columns over a batch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import lit_list


def escaped(keyword: str) -> str:
    """A keyword as a pattern that Java and RE2 read alike."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", keyword.lower())


def technologies(q: Column, dictionary: dict[str, list[str]] = fixed.TECHNOLOGIES) -> Column:
    """Names whose keywords occur as whole words; one pattern for each name."""
    hits = [F.when(q.rlike(r"\b(?:" + "|".join(map(escaped, words)) + r")\b"), F.lit(name)) for name, words in dictionary.items()]
    return F.array_compact(F.array(*hits))


def intent_counts(q: Column, patterns: dict[str, list[str]] = fixed.INTENT_PATTERNS) -> dict[str, Column]:
    return {intent: sum((q.rlike(p).cast("int") for p in ps), F.lit(0)) for intent, ps in patterns.items()}


def file_references(question: Column) -> Column:
    """Words that look like files, then files named after `file`, `in` or `to`."""
    ends = lambda w: F.exists(lit_list(fixed.FILE_EXTENSIONS), lambda e: w.endswith(e))
    holds = lambda w: F.exists(lit_list(fixed.FILE_EXTENSIONS), lambda e: w.contains(e))
    words = F.transform(F.filter(F.split(question, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "[.,;:!?]+$", ""))
    direct = F.filter(words, lambda w: ends(w) | ((w.contains("/") | w.contains("\\")) & holds(w)))
    named = [F.transform(F.regexp_extract_all(question, F.lit(rf"(?i)\b{word}\s+\w+\.\w+\b"), 0), lambda m: F.element_at(F.split(m, r"\s+"), -1)) for word in ("file", "in", "to")]
    after = F.filter(F.array_except(F.concat(*named), direct), ends)
    return F.concat(direct, after)


def key_terms(q: Column, techs: Column) -> Column:
    words = F.regexp_extract_all(q, F.lit(r"\b[a-zA-Z][a-zA-Z0-9_-]*\b"), 0)
    own = F.flatten(F.array(*[F.when(F.array_contains(techs, t), lit_list([k.lower() for k in ks])).otherwise(F.array().cast("array<string>")) for t, ks in fixed.TECHNOLOGIES.items()]))
    short, stop = lit_list(fixed.SHORT_TERMS), lit_list(fixed.STOP_WORDS)
    kept = F.filter(words, lambda w: F.array_contains(short, w) | (~F.array_contains(stop, w) & (F.length(w) > 2)))
    return F.slice(F.array_except(kept, own), 1, fixed.MOST_TERMS)  # distinct, in order


def analysis(questions: DataFrame, column: str = "question") -> DataFrame:
    """Add q, techs, intent, sure, terms, files, about_files and confidence.

    Blank questions have the default intent, no terms and confidence 0.
    """
    question = F.col(column)
    base = questions.withColumn("q", F.trim(F.lower(question), F.lit(" \t\n\r")))
    q = F.col("q")
    counts = intent_counts(q)
    base = base.select("*", technologies(q).alias("techs"), *[n.alias(f"n_{i}") for i, n in counts.items()])
    n = {i: F.col(f"n_{i}") for i in counts}
    most = F.greatest(*n.values())
    tie = (n["how_to"] == most) & (n["problem_solving"] == most) & q.rlike(fixed.PROBLEM_WORDS)
    intent = F.when(most == 0, fixed.DEFAULT_INTENT).when(tie, "problem_solving")
    share = F.lit(0.0)
    for i, c in n.items():
        intent = intent.when(c == most, i)
    for i, patterns in fixed.INTENT_PATTERNS.items():
        share = F.when(F.col("intent") == i, F.col("most") / F.lit(len(patterns))).otherwise(share)
    base = base.select("*", most.alias("most"), intent.alias("intent")).drop(*[f"n_{i}" for i in counts])
    sure = F.when(F.col("most") == 0, fixed.DEFAULT_INTENT_CONFIDENCE).otherwise(F.least(F.lit(1.0), F.lit(0.4) + share * 0.6))
    base = base.select("*", sure.alias("sure"), key_terms(q, F.col("techs")).alias("terms"), file_references(question).alias("files"))
    terms = F.when(F.size("terms") >= 2, 0.2).when(F.size("terms") == 1, 0.1).otherwise(0.0)
    total = F.col("sure") * 0.4 + F.when(F.size("techs") > 0, 0.2).otherwise(0.0) + terms + F.when(F.col("intent") != fixed.DEFAULT_INTENT, 0.2).otherwise(0.0)
    return base.select(
        "*", ((F.size("files") > 0) | question.rlike(r"(?i)\bfile\s*(change|edit|modif)")).alias("about_files"),
        F.when(q == "", 0.0).otherwise(F.least(F.lit(1.0), total)).alias("confidence"),
    ).drop("most")


def matching_patterns(questions: DataFrame) -> DataFrame:
    """qid, intent and place of every intent pattern that a question matches."""
    q = F.lower("question")
    hits = F.array(*[F.when(q.rlike(p), F.struct(F.lit(i).alias("intent"), F.lit(k).alias("place"))) for i, ps in fixed.INTENT_PATTERNS.items() for k, p in enumerate(ps)])
    return questions.select("qid", F.inline(F.array_compact(hits)))


def refinements() -> Column:
    """At most three better questions, from the columns of :func:`analysis`."""
    q, intent = F.col("q"), F.col("intent")
    none = F.size("techs") == 0
    more = lambda when, word, text: F.when(when & ~q.contains(word), text)
    how, problem, code = intent == "how_to", intent == "problem_solving", intent == "code_example"
    after = lambda word: F.concat(q, F.lit(" " + word))
    ideas = [
        F.when(none, after("python")), F.when(none, after("implementation")), more(how, "example", after("example")), more(how, "step", after("steps")),
        more(problem, "fix", F.concat(F.lit("fix "), q)), more(problem, "solution", after("solution")), more(code, "code", after("code")),
    ]
    return F.slice(F.array_compact(F.array(*ideas)), 1, 3)
