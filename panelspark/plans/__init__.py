"""Registered queries and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from panelspark.plans.fixtures import scoped


def collected() -> tuple[dict, dict[str, str]]:
    """Queries and SQL of every module of this package that registers some."""
    queries, sql = {}, {}
    for m in pkgutil.iter_modules(__path__):
        module = importlib.import_module(f"{__name__}.{m.name}")
        queries |= {name: scoped(f) for name, f in getattr(module, "Q", {}).items()}
        sql |= getattr(module, "SQL", {})
    return queries, sql
