"""Registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from .plans import causes, checks, corpus, extras, inputs, library, nested, outline, packages, scans, states, texts

FLAGSHIP = "corpus_report"
MODULES = [library, texts, corpus, extras, checks, inputs, outline, nested, states, scans, packages, causes]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
