from __future__ import annotations

import datetime
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ledgerloom.sources.schema import SALES_COLUMNS  # noqa: E402
from ledgerloom.sources.tables import rows_to_sales  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("ledgerloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "date": "2024-03-15",
    "product": "Mouse",
    "quantity": 1,
    "unit_price": 10.0,
    "customer_id": "c1",
    "customer_name": "Ann Example",
    "customer_email": "ann@example.com",
    "customer_segment": "Consumer",
    "region": "North",
    "sales_channel": "Online",
    "salesperson": "Sam",
    "salesperson_tier": "average_performer",
    "discount_percent": 0.0,
    "total_amount": 10.0,
}


@pytest.fixture(scope="session")
def make_sales(spark):
    """Sales from short rows; what a row leaves out is filled in."""

    def make(*rows: dict):
        full = []
        for at, row in enumerate(rows):
            values = {"transaction_id": f"t{at}"} | DEFAULTS | row
            if isinstance(values["date"], str):
                values["date"] = datetime.date.fromisoformat(values["date"])
            full.append({name: values[name] for name in SALES_COLUMNS})
        return rows_to_sales(spark, full)

    return make


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as plain tuples of the named columns (all when none is named)."""

    def collect(frame, *columns):
        return [tuple(r) for r in (frame.select(*columns) if columns else frame).collect()]

    return collect


@pytest.fixture(scope="session")
def plan_of():
    """Physical plan text of a frame, before it runs."""

    def text(frame) -> str:
        return frame._jdf.queryExecution().explainString(
            frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )

    return text
