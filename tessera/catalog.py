"""Registered queries of the library and the SQL they are held against."""

from __future__ import annotations

from tessera.queries import ORACLE_SQL, QUERIES
from tessera.queries import documents as _documents  # noqa: F401
from tessera.queries import functions as _functions  # noqa: F401  registers its queries
from tessera.queries import listings as _listings  # noqa: F401
from tessera.queries import records as _records  # noqa: F401
from tessera.queries import traffic as _traffic  # noqa: F401

FLAGSHIP = "fit_rank"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
