"""All queries of the engine and their SQL."""

from __future__ import annotations

from prefforge.plans import pipelines, relational, scalars  # noqa: F401  they register their queries
from prefforge.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
