"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import checks, documents, ingestion, metrics, search

MODULES = (metrics, ingestion, checks, documents, search)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE.items()}
