"""Every registered query of the routing engine, with its DuckDB twin."""

from __future__ import annotations

from switchyard.plans import columns, effects, forecasting, history, rates, relational, routing, rules  # noqa: F401
from switchyard.registry import QUERIES, SQL, Query
from switchyard.streaming import monitor  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
