"""Every query of the library agrees with its SQL on the smallest tables."""

from __future__ import annotations

import decimal
import math

import pytest

from palimpsest.plans import catalog

from .conftest import SMALL


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != int(v) else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    return v


def rows_of(names, columns, rows):
    places = [columns.index(c) for c in names]
    return sorted((tuple(plain(r[i]) for i in places) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SMALL)
    rows = found.collect()
    assert len(set(found.columns)) == len(found.columns)
    if name in catalog.ORACLES:
        said = duck.sql(catalog.ORACLES[name])
        names = sorted(found.columns)
        assert names == sorted(said.columns)
        assert rows_of(names, found.columns, rows) == rows_of(names, said.columns, said.fetchall())
