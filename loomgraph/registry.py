"""The library's registered queries and their SQL, by query name."""

from __future__ import annotations

from .plans.queries import QUERIES, SQL, Query

__all__ = ["Query", "oracle_sql", "queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
