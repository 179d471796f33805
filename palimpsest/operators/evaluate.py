"""Evaluation of search results against the analysis of a question, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import tokens


def intent_mark(content: Column, intent: Column) -> Column:
    mark = F.lit(0.5)
    for name, (cues, by) in fixed.INTENT_CUES.items():
        found = sum((content.contains(c).cast("int") for c in cues), F.lit(0))
        mark = F.when(intent == name, F.least(F.lit(1.0), found / F.lit(float(by)))).otherwise(mark)
    return mark


def distance(score: Column) -> Column:
    """A usable distance: not a number counts as 0.5, others are clipped to 0..1."""
    s = score.cast("double")
    bad = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return F.when(bad, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


def marked(analysis: DataFrame, results: DataFrame) -> DataFrame:
    """Every result under every question, with its mark and place.

    ``results`` is a top-k list of at most MOST_RESULTS rows. What depends on a result alone (its place and
    its tokens) is told once, before the results meet the questions.
    """
    one = F.lit(1).alias("one")
    nth = (F.row_number().over(Window.orderBy("score", "id")) - 1).alias("nth")  # at most MOST_RESULTS rows
    told = results.limit(fixed.MOST_RESULTS).select("*", F.array_distinct(tokens(F.col("content"))).alias("held"), nth, one)
    both = analysis.select("qid", "q", "intent", "techs", "terms", F.col("confidence").alias("analysis_confidence"), F.array_distinct(tokens(F.col("q"))).alias("words"), one).join(F.broadcast(told), "one").drop("one")
    low = F.lower("content")
    both = both.select("*", F.size("words").alias("asked"), F.size(F.array_intersect("words", "held")).cast("long").alias("shared")).drop("words", "held")
    named = F.exists("techs", lambda t: low.contains(t))
    change = F.when(F.col("chunk_type") == "file_change", 0.1).otherwise(0.0)
    kind = F.when(F.col("intent") == "file_history", change).otherwise(F.when(F.col("chunk_type") == "turn", 0.05).otherwise(0.0))
    mark = (1 - distance(F.col("score"))) * 0.4 + F.when(F.col("asked") > 0, F.col("shared") / F.col("asked") * 0.3).otherwise(0.0) + F.when(named, 0.1).otherwise(0.0) + intent_mark(low, F.col("intent")) * 0.2 + kind
    return both.select("*", F.least(F.lit(1.0), mark).alias("mark"))


def evaluation(marks: DataFrame) -> DataFrame:
    """Relevance, completeness, confidence, suggestions and missing information of each question."""
    m, n = F.col("mark"), F.count(F.lit(1))
    spread = F.when(n > 1, 1 - F.least(F.lit(1.0), F.var_pop(m) * 2)).otherwise(0.5)
    good = F.avg(F.when(m >= 0.5, 1.0).otherwise(0.0))
    unmet = F.filter("techs", lambda t: ~F.lower("content").contains(t))
    e = marks.select("*", unmet.alias("unmet")).groupBy("qid").agg(
        F.first("intent").alias("intent"), n.alias("n"), (F.sum(m / (F.col("nth") + 1)) / F.sum(1.0 / (F.col("nth") + 1))).alias("relevance"), F.avg(m).alias("mean"), F.max(m).alias("best"),
        F.least(F.lit(1.0), F.least(F.lit(1.0), n / float(fixed.ENOUGH_RESULTS)) * 0.3 + good * 0.5 + spread * 0.2).alias("completeness"),
        F.first("analysis_confidence").alias("analysis_confidence"), F.bool_or(F.col("content").contains("```")).alias("code"), F.bool_or(F.col("chunk_type") == "file_change").alias("changes"),
        F.first("techs").alias("techs"), F.collect_list("unmet").alias("unmet"),
    )
    absent = F.filter("techs", lambda t: F.forall("unmet", lambda u: F.array_contains(u, t)))
    is_ = lambda i: F.col("intent") == i
    ideas = F.array_compact(F.array(
        F.when(F.col("mean") < 0.5, "Add more specific keywords"), F.when(is_("code_example") & ~F.col("code"), "Add 'example' or 'code' to query"),
        F.when(is_("how_to"), "Try adding 'steps' or 'guide'"), F.when(is_("file_history") & ~F.col("changes"), "Use search_file_changes tool instead")))
    gaps = F.array_compact(F.array(F.when(is_("code_example") & ~F.col("code"), "Code examples"), F.when(is_("file_history") & ~F.col("changes"), "File change history")))
    poor = F.col("best") < 0.3
    sure = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("n") / 5.0) * 0.3 + F.col("mean") * 0.4 + F.col("analysis_confidence") * 0.3)
    return e.select(
        "qid", "intent", "n", "relevance", "completeness", sure.alias("confidence"),
        ((F.col("relevance") < fixed.ADEQUATE) | (F.col("completeness") < fixed.COMPLETE)).alias("needs_refinement"),
        F.when(poor, F.array(F.lit("Try more general search terms"))).otherwise(F.slice(ideas, 1, 3)).alias("suggestions"),
        F.when(poor, F.array(F.lit("No closely matching content found"))).otherwise(F.slice(F.concat(gaps, F.transform(absent, lambda t: F.concat(F.lit("Information about "), t))), 1, 3)).alias("missing"),
    )
