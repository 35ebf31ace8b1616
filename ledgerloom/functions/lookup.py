"""Lookups: fixed tables as literal maps, a caller's table as a join.

A fixed table of a few dozen entries folds into a map literal inside the expression, so
looking a label up needs no join, no broadcast job and no shuffle.  A table that a caller
brings as a DataFrame may have any size: it is left-joined on its unique key, and Spark
decides by its size how.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

Value = str | int | float


def lookup(table: Mapping[str, Value], key: str | Column, value_type: str) -> Column:
    """Value for the key, or null when the key is null or not in the table."""
    return F.try_element_at(F.expr(_map(table, value_type)), F.col(key) if isinstance(key, str) else key)


def translated_sql(table: Mapping[str, str], key_sql: str) -> str:
    """SQL for a label's translation; an unknown label stays as it is."""
    return f"coalesce(try_element_at({_map(table, 'string')}, {key_sql}), {key_sql})"


def _map(table: Mapping[str, Value], value_type: str) -> str:
    entries = ", ".join(f"{_quoted(label)}, {_sql(value)}" for label, value in table.items())
    return f"cast(map({entries}) as map<string, {value_type}>)"


def with_value(
    frame: DataFrame, table: Mapping[str, Value] | DataFrame, key: str, value_type: str, column: str
) -> DataFrame:
    """Add the value for the row's key, null when the table does not hold it.  A DataFrame's
    first column is its unique key, the second the value."""
    if not isinstance(table, DataFrame):
        return frame.withColumn(column, lookup(table, key, value_type))
    known, value = table.columns[:2]
    entries = table.select(F.col(known).alias("_key"), F.col(value).cast(value_type).alias(column))
    return frame.join(entries, frame[key] == entries["_key"], "left").drop("_key")


def _sql(value: Value) -> str:
    return _quoted(value) if isinstance(value, str) else repr(value)


def _quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
