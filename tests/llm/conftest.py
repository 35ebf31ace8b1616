from __future__ import annotations

import pytest


@pytest.fixture
def table_of(spark):
    """A frame from rows and a schema, with columns whose names operators use themselves."""

    def make(rows, schema, extra=True):
        from pyspark.sql import functions as F

        frame = spark.createDataFrame(rows, schema)
        if extra:
            frame = frame.withColumns({name: F.lit(name) for name in ("score", "fp", "root", "n", "size", "node", "key")})
        return frame

    return make
