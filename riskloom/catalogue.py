"""All queries of the core library with their oracle SQL."""

from __future__ import annotations

from riskloom.plans import record_queries, risk_queries, series_queries, study_queries

_ALL = series_queries.QUERIES | risk_queries.QUERIES | record_queries.QUERIES | study_queries.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: text for name, (_, text) in _ALL.items() if text is not None}
