"""Additive parts of aggregates: sums and counts that can be added up in steps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.measures import rounded_quotient

ROWS = "_rows"


def parts(frame: DataFrame, keys: Sequence[str], columns: Iterable[str], *others: Column) -> DataFrame:
    """Per key the number of rows, and each column's sum and number of non-null values (and other
    aggregates)."""
    columns = list(columns)
    sums = [F.sum(c).alias(f"{c}_sum") for c in columns]
    counts = [F.count(c).alias(f"{c}_n") for c in columns]
    return frame.groupBy(*keys).agg(F.count("*").alias(ROWS), *sums, *counts, *others)


def merged(given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of finer keys added up."""
    added = [c for c in given.columns if c not in keys]
    return given.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in added])


def part_total(column: str) -> Column:
    """Sum; null when every value in the group is null."""
    return F.col(f"{column}_sum").cast("double")


def part_mean(column: str) -> Column:
    """Exact sum over the number of non-null values, as double."""
    return F.try_divide(part_total(column), F.col(f"{column}_n"))


def part_total_or_zero(column: str) -> Column:
    """Sum; 0 when every value in the group is null."""
    return F.coalesce(part_total(column), F.lit(0.0))


def part_rounded_mean(column: str) -> Column:
    """Mean of a two-place decimal column, rounded half-even to two places."""
    return rounded_quotient(F.col(f"{column}_sum"), F.col(f"{column}_n"))


def part_count_or_zero(column: str) -> Column:
    """Integer sum; 0 when every value in the group is null."""
    return F.coalesce(F.col(f"{column}_sum"), F.lit(0)).cast("bigint")
