"""Queries over the given tables, each with its SQL oracle where there is one."""

from __future__ import annotations

import importlib
import pkgutil


def all_queries() -> dict:
    """name -> (function of Tables, oracle SQL or None), from every module of this package."""
    found: dict = {}
    for module in pkgutil.iter_modules(__path__):
        queries = getattr(importlib.import_module(f"{__name__}.{module.name}"), "QUERIES", {})
        clash = found.keys() & queries.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        found.update(queries)
    return found
