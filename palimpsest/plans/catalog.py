"""Registry of the queries and of the SQL each must agree with."""

from __future__ import annotations

import importlib
import pkgutil

import palimpsest.plans as plans

from .registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _module not in ("catalog", "registry", "tables"):
        importlib.import_module(f"palimpsest.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
