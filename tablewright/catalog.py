"""Registry of the reference operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.plans import flow_queries, governance_queries, listing_queries, more_queries, page_queries, relational_queries, scalar_queries, source_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES: list = [scalar_queries, page_queries, relational_queries, governance_queries, flow_queries, source_queries, more_queries, listing_queries]


def queries() -> dict[str, Query]:
    """All registered queries."""
    out: dict[str, Query] = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    """SQL for those queries that DuckDB can express."""
    out: dict[str, str] = {}
    for module in MODULES:
        out.update(module.SQL)
    return out
