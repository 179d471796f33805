"""Models that turn texts into vectors, behind one call: texts in, vectors out, in order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Provider(Protocol):
    """What an embedding model must do."""

    dimension: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class IndexedProvider:
    """A service that answers a batch with (index, vector) items in any order."""

    def __init__(self, ask: Callable[[list[str]], list[tuple[int, list[float]]]], dimension: int):
        self.ask, self.dimension = ask, dimension

    def __call__(self, texts: list[str]) -> list[list[float]]:
        items = dict(self.ask(texts))
        if sorted(items) != list(range(len(texts))):
            raise ValueError("the answer does not have each index once")
        if any(len(v) != self.dimension for v in items.values()):
            raise ValueError("a vector has the wrong length")
        return [items[i] for i in range(len(texts))]


class SingleProvider:
    """A service that takes one text a request, with the kind of task."""

    def __init__(self, ask: Callable[[str, str], list[float]], dimension: int, task: str = "document"):
        self.ask, self.dimension, self.task = ask, dimension, task

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self.ask(t, self.task) for t in texts]


def register_model(spark: SparkSession, name: str, provider: Provider) -> None:
    """Make a model callable in SQL; registering it again replaces it."""

    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(provider(texts.fillna("").tolist()))

    from pyspark.sql import functions as F

    spark.udf.register(name, F.pandas_udf(embed, T.ArrayType(T.FloatType())))


def embedded(chunks: DataFrame, provider: Provider, rows_a_call: int = 100) -> DataFrame:
    """id and vector of (id, content); at most ``rows_a_call`` texts go into one call of the model."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), rows_a_call):
                part = batch.iloc[a : a + rows_a_call]
                yield pd.DataFrame({"id": part["id"], "vector": provider(part["content"].tolist())})

    return chunks.select("id", "content").mapInPandas(run, "id string, vector array<float>")
