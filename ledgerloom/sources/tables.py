"""Reading, writing and describing ``sales`` tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.ordering import ascending
from ledgerloom.sources.schema import FOLDER_COLUMNS, SALES_SCHEMA, conform


def use_namespace(spark: SparkSession, catalog: str | None = None, schema: str | None = None) -> None:
    """Set the default catalog and schema that table names resolve against."""
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    if schema:
        spark.catalog.setCurrentDatabase(schema)


def list_tables(spark: SparkSession) -> list[str]:
    """Names of the tables and views in the current schema."""
    return sorted(table.name for table in spark.catalog.listTables())


def sales_table(spark: SparkSession, name: str = "sales") -> DataFrame:
    """A catalog table or view by name."""
    return conform(spark.table(name))


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files, plain or written by :func:`write_sales`."""
    return conform(spark.read.parquet(path))


def rows_to_sales(spark: SparkSession, rows: Iterable[Mapping[str, Any]]) -> DataFrame:
    """A frame from client-side rows keyed by the documented column names."""
    return conform(spark.createDataFrame([dict(row) for row in rows], SALES_SCHEMA))


def append_sales(sales: DataFrame, more: DataFrame) -> DataFrame:
    """Both inputs' rows, duplicates kept, columns matched by name."""
    return sales.unionByName(more)


def write_sales(sales: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Snappy Parquet, partitioned by year and month of the sale date (FOLDER_COLUMNS).

    The rebalance step sends a month's rows to as few tasks as make well-sized
    files, and lets adaptive execution cut a large month into several tasks, so
    neither thousands of tiny files nor one huge task arises.
    """
    year, month = FOLDER_COLUMNS
    (
        sales.withColumns({year: F.year("date"), month: F.month("date")})
        .hint("rebalance", year, month)
        .write.mode(mode)
        .partitionBy(year, month)
        .option("compression", "snappy")
        .parquet(path)
    )


def row_count(sales: DataFrame) -> DataFrame:
    return sales.agg(F.count("*").alias("n"))


def preview(sales: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First rows.  Without an order any ``n`` rows come back and only as many files
    as needed are read; with an order the result is repeatable."""
    return (sales.orderBy(*ascending(*order_by)) if order_by else sales).limit(n)


def profile(sales: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count, column count and column names.

    Name the ``columns`` to describe a table whose view was narrowed for counting.
    """
    names = columns or sales.columns
    return sales.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(names)).alias("n_columns"),
        F.lit(",".join(names)).alias("column_names"),
    )
