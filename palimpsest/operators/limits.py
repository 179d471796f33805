"""Bounds of requests and of what is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed

#: Longest question, largest limit, largest count, by caller.
BOUNDS = {"http": (512, 100, 50), "tool": (10_000, 50, 20)}
#: Most elements shown of each list.
SHOWN = {"terms": fixed.MOST_TERMS, "suggestions": 3, "missing": 3, "points": fixed.MOST_POINTS, "snippets": fixed.MOST_SNIPPETS, "results": fixed.MOST_RESULTS}


def request_error(question: Column, limit: Column, caller: str) -> Column:
    """Why a request is refused, or null."""
    longest, most, _ = BOUNDS[caller]
    return F.when(F.trim(question) == "", "empty question").when(F.length(question) > longest, "question too long").when(~limit.between(1, most), "limit out of range")


def clamped(count: Column, caller: str = "tool") -> Column:
    return F.least(F.greatest(count, F.lit(1)), F.lit(BOUNDS[caller][2]))


def shown(values: Column, kind: str) -> Column:
    return F.slice(values, 1, SHOWN[kind])
