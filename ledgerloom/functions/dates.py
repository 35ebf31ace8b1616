"""Calendar expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F


def month_start(column: str | Column) -> Column:
    """First day of the month of a date."""
    return F.trunc(column, "MM")


def month_label(column: str | Column) -> Column:
    """``yyyy-MM`` text of a date."""
    return F.date_format(column, "yyyy-MM")


def label_month_start(label: str) -> Column:
    """First day of the month named by ``yyyy-MM`` text (folded to a literal)."""
    return F.to_date(F.lit(label), "yyyy-MM")


def as_date(value: date | str) -> Column:
    """A date literal from a ``date`` or ISO text."""
    return F.lit(value).cast("date")


def month_number(column: str | Column) -> Column:
    """Months since year 0; a number that orders calendar months."""
    return F.year(column) * 12 + F.month(column)
