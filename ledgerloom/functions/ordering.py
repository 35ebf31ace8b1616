"""Total orders: nulls last, and a tie-break so top-k sets are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def largest_first(metric: str, *keys: str) -> list[Column]:
    return [F.desc_nulls_last(metric), *ascending(*keys)]


def smallest_first(metric: str, *keys: str) -> list[Column]:
    return [F.asc_nulls_last(metric), *ascending(*keys)]


def last_of_largest_first(metric: str, *keys: str) -> list[Column]:
    """Exact reverse of :func:`largest_first`; its first k rows are the last k there."""
    return [F.asc_nulls_first(metric), *(F.desc_nulls_first(k) for k in keys)]


def ascending(*keys: str) -> list[Column]:
    return [F.asc_nulls_last(k) for k in keys]
