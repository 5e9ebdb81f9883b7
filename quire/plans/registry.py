"""All registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

import importlib

MODULES = ["intake", "chunk", "answer", "scan", "leak", "layout", "assembly", "record", "history", "stream"]


def _all() -> dict:
    found: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"quire.plans.{name}_queries")
        overlap = found.keys() & module.QUERIES.keys()
        if overlap:
            raise ValueError(f"registered twice: {sorted(overlap)}")
        found.update(module.QUERIES)
    return found


def queries() -> dict:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
