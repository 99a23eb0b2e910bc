"""All queries of the disclosure and price jobs, and their SQL."""

from __future__ import annotations

from . import event_queries, fund_queries, signal_queries, source_queries

PARTS = [fund_queries, signal_queries, event_queries, source_queries]


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.SQL.items()}
