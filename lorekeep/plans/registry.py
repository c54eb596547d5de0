"""All queries of the engine's own operators, by name, with their SQL equivalents."""

from __future__ import annotations

import importlib

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL equivalent if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the modules of queries, which register themselves."""
    for name in ("log", "events", "text", "review", "sessions", "trees", "feedback", "writing", "asked", "ledgers", "streams"):
        importlib.import_module(f"lorekeep.plans.{name}")
