"""All named queries of the library and their oracle SQL."""

from __future__ import annotations

from . import analytics, answers, assurance, benchmarks, chunks, code, maintenance, relational, retrieval, rollups, rules, streams

MODULES = [retrieval, answers, relational, analytics, benchmarks, assurance, maintenance, rollups, rules, chunks, code, streams]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
