"""Number-to-text expressions for headline figures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def grouped_text(value: Column, places: int = 0) -> Column:
    """Fixed places with a thousands mark, rounded half-even."""
    return F.format_number(value, places)


def plain_text(value: Column, places: int) -> Column:
    """Fixed places without a thousands mark, rounded half-even."""
    return F.translate(F.format_number(value, places), ",", "")


def dollars(text: Column) -> Column:
    return F.concat(F.lit("$"), text)


def percent(text: Column) -> Column:
    return F.concat(text, F.lit("%"))
