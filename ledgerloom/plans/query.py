"""A named query."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.schema import SALES_COLUMNS
from ledgerloom.sources.star import product_parts, sales_view


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def on_sales(
    name: str,
    operator: Callable[[DataFrame], DataFrame],
    sql: str | None,
    columns: str | Iterable[str] = SALES_COLUMNS,
    exact: bool = True,
    labels: Mapping[str, Mapping[str, str]] | None = None,
) -> Query:
    """A query that applies an operator to the sales view.  ``columns`` (names, or one
    space-separated text) decides which dimension joins are planned; ``exact=False`` is
    for operators that list rows and sum nothing; ``labels`` translates dimension columns."""
    wanted = columns.split() if isinstance(columns, str) else tuple(columns)

    def build(spark: SparkSession, folder: str) -> DataFrame:
        return operator(sales_view(spark, folder, wanted, exact, labels))

    return Query(name, build, sql)


def on_products(name: str, operator: Callable[[DataFrame], DataFrame], sql: str | None, columns: str) -> Query:
    """A query over measures added up per product; ``columns`` are the measures."""
    wanted = [name for name in columns.split() if name != "product"]

    def build(spark: SparkSession, folder: str) -> DataFrame:
        return operator(product_parts(spark, folder, wanted))

    return Query(name, build, sql)
