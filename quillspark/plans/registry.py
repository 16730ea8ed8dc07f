"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import audit, carving, coverage, curation, ingest, landing, library, packs, parsing, search, state, streams, works

MODULES = (library, search, audit, packs, state, ingest, streams, coverage, curation, works, parsing, landing, carving)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL: dict = {name: sql for module in MODULES for name, sql in module.SQL.items()}
