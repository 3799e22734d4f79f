"""The operators over the given tables and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from tessera.sources.adapters import with_views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL where that can say the same."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return f

    return register
