"""Every named query: how Spark builds it, which sales columns it reads, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import dashboard, notebook, rulequeries
from ledgerloom.plans.query import Query


def all_queries() -> list[Query]:
    """Queries in catalogue order; names are unique."""
    found = [*notebook.QUERIES, *dashboard.QUERIES, *rulequeries.QUERIES]
    names = [query.name for query in found]
    if len(names) != len(set(names)):
        raise ValueError("two queries share a name")
    return found


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.name: query.build for query in all_queries()}


def sql_twins() -> dict[str, str]:
    return {query.name: query.sql for query in all_queries() if query.sql}
