"""All registered queries of the library proper, with the SQL that gives the same rows."""

from __future__ import annotations

from lexispark.plans import queries_models, queries_relational, queries_runs, queries_structured, queries_text  # noqa: F401
from lexispark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
