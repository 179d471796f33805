"""One configuration object; bad values fall back to the defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import fixed


@dataclass(frozen=True)
class Config:
    search_limit: int = 10
    candidate_pool: int = fixed.CANDIDATE_POOL
    rrf_k: int = fixed.RRF_K
    adequate: float = fixed.ADEQUATE
    complete: float = fixed.COMPLETE
    cache_entries: int = 100
    cache_seconds: float = 300.0
    refine: bool = True
    embedding_batch: int = 32
    embedding_retries: int = 2

    @classmethod
    def from_environment(cls, prefix: str = "PALIMPSEST_") -> Config:
        """Settings named prefix + FIELD; values that do not parse or are negative are ignored."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            kind = type(f.default)
            try:
                value = None if raw is None else raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
            except ValueError:
                value = None
            if value is not None and (kind is bool or value >= 0):
                found[f.name] = value
        return cls(**found)


def setting(name: Column, raw: Column) -> Column:
    """The value of a reported setting as text: ``raw`` read as its field wants, else the field's default."""
    value = F.lit(None).cast("string")
    for f in fields(Config):
        kind = type(f.default)
        number = raw.try_cast("double" if kind is float else "bigint")
        read = F.when(F.lower(raw).isin("1", "true", "yes"), "True").otherwise("False") if kind is bool else F.when(number >= 0, number.cast("string")).otherwise(str(f.default))
        value = F.when(name == f.name, read).otherwise(value)
    return value
