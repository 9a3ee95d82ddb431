"""Registered queries: each operator over the given tables, with an independent SQL oracle."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from cairn.plans import catalog_queries, estimate_queries, stat_queries, stream_queries, tree_queries  # noqa: E402, F401
