"""Row count and date range from file statistics.

Parquet files hold the number of their rows and each column's smallest and largest value.  Spark's V2
Parquet source answers such aggregates from them, so no data page is read.  It is a setting
of the session, so these frames belong to a session of their own that shares the context and
leaves the caller's settings alone.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def file_summary(spark: SparkSession, path: str, column: str = "date") -> DataFrame:
    """One row: ``n``, ``min_<column>`` and ``max_<column>`` of the Parquet files at ``path``, those that
    ``write_sales`` and ``append_batch`` write or any others.

    Where a file lacks the statistics (as one does in which the column is always null), or the column is
    of a kind whose statistics may be cut short, the column itself is read.
    """
    own = spark.newSession()
    for key, value in _SETTINGS.items():
        own.conf.set(key, value)
    pushed = _summary(own.read.parquet(path), column)
    try:
        pushed.collect()  # one row; a file without statistics fails here
    except (PySparkException, Py4JJavaError):
        return _summary(spark.read.parquet(path), column)
    return pushed


def _summary(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.count("*").alias("n"), F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}"))
