"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from gleaner.plans import corpus, engine, gates, reading, retrieval, routes, tables  # noqa: F401  they fill the registry
from gleaner.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "bm25_recall"
