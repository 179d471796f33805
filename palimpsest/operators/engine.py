"""The whole search of one question: analyse, search, evaluate, refine once, synthesize."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from . import analyze, cache, evaluate, synthesize
from .search import Filters, hybrid_search
from .textindex import TextIndex

MOST_QUESTION = 10_000


@dataclass
class Answer:
    analysis: dict
    results: list[dict]
    evaluation: dict
    synthesis: dict | None
    refined: bool
    cached: bool


@dataclass
class Engine:
    """Searches one chunk table. Result lists are short, so the steps after the search run on them.

    ``embed`` turns a question into a vector. ``version`` names the state of the table and is
    part of every cache key, so a changed table is never answered from old entries.
    """

    spark: SparkSession
    chunks: DataFrame
    embed: Callable[[str], list[float]]
    version: str = "0"
    index: TextIndex | None = None
    config: Config = field(default_factory=Config)

    def __post_init__(self):
        self.cache = cache.Cache(self.config.cache_entries, self.config.cache_seconds)

    def ask(self, question: str, limit: int | None = None, filters: Filters = Filters(), synthesis: bool = True) -> Answer:
        if not question.strip() or len(question) > MOST_QUESTION:
            raise ValueError(f"a question has 1 to {MOST_QUESTION} characters")
        limit = limit or self.config.search_limit
        analysed = self._analysed(question)
        seen = analysed.first().asDict()
        name = cache.key(question, filters.project_name, "hybrid", limit, self.version, filters)
        held = self.cache.get(name)
        results = held if held is not None else self._search(question, limit, filters)
        judged, refined = self._judged(analysed, results), False
        if held is None and self.config.refine and judged["needs_refinement"]:
            ideas = analysed.select(analyze.refinements().alias("r")).first()["r"]
            if ideas:
                other = self._search(ideas[0], limit, filters)
                better = self._judged(analysed, other)
                if better["relevance"] > judged["relevance"]:
                    results, judged, refined = other, better, True
        if results:
            self.cache.put(name, results)
        told = self._synthesis(results, seen) if synthesis and results else None
        return Answer(seen, results, judged, told, refined, held is not None)

    def _analysed(self, question: str) -> DataFrame:
        one = self.spark.range(1).select(F.lit(0).alias("qid"), F.lit(question).alias("question"))
        return analyze.analysis(one)

    def _search(self, question: str, limit: int, filters: Filters) -> list[dict]:
        found = hybrid_search(self.chunks, question, self.embed(question), limit, filters, self.config.candidate_pool, self.index)
        return [r.asDict() for r in found.orderBy("score", "id").collect()]  # at most ``limit`` rows

    _FIELDS = "id string, content string, chunk_type string, session_id string, project_path string, project_name string, timestamp timestamp, file_path string, operation string, machine_id string, score double"

    def _frame(self, results: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r[f.split()[0]] for f in self._FIELDS.split(", ")) for r in results], self._FIELDS)

    def _judged(self, analysed: DataFrame, results: list[dict]) -> dict:
        if not results:
            return {"relevance": 0.0, "completeness": 0.0, "confidence": 0.9, "needs_refinement": True, "suggestions": [], "missing": []}
        return evaluate.evaluation(evaluate.marked(analysed, self._frame(results))).first().asDict()

    def _synthesis(self, results: list[dict], seen: dict) -> dict:
        words = lambda values: F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")
        frame = self._frame(results).select(F.lit(0).alias("qid"), "*", words(seen["techs"]).alias("techs"), words(seen["terms"]).alias("terms"))
        return synthesize.synthesized(frame).first().asDict()
