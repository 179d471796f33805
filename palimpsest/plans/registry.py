"""Where query modules register: name, function and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with SQL where SQL can say the same."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def texts(values: list[str]) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join(map(text, values)) + "]::VARCHAR[]"
