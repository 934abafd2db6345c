"""All queries of the library, by name."""

from __future__ import annotations

from tessella.plans import function_queries, group_queries, shape_queries, text_queries  # noqa: F401  (they register themselves)
from tessella.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
