"""Registered queries of the library and their SQL."""

from __future__ import annotations

from .plans import analytics_queries, clean_queries, hook_queries, indicator_queries, more_queries, quality_queries, stream_queries, trade_queries

MODULES = [clean_queries, indicator_queries, quality_queries, trade_queries, analytics_queries, stream_queries, more_queries, hook_queries]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
