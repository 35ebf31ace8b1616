"""Rows between Spark and a client, in Arrow, in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.sources.schema import DOCUMENTED_TYPES, EXACT_TYPES, conform
from ledgerloom.sources.scratch import fresh_path

ROWS_PER_BATCH = 50_000
_ARROW = {"string": pa.string(), "date": pa.date32(), "bigint": pa.int64(), "double": pa.float64()}
CLIENT_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in DOCUMENTED_TYPES.items()])


def arrow_to_sales(spark: SparkSession, pieces: Iterable[pa.Table | pa.RecordBatch], path: str | None = None) -> DataFrame:
    """A ``sales`` frame from client-side Arrow tables or batches.

    Columns are matched by name and cast to the documented types; a column that is missing or
    unknown, or a value that does not fit, is an error.  No Python object is made per
    cell.  Each piece is written below ``path`` (a folder all executors share; one of the
    application's own if not given) before the next one is taken, so the client needs memory for one piece.
    """
    path = path or fresh_path(spark, "client-rows")
    empty = True
    for piece in pieces:
        table = pa.Table.from_batches([piece]) if isinstance(piece, pa.RecordBatch) else piece
        if set(table.column_names) != set(CLIENT_SCHEMA.names):
            raise ValueError(f"not the sales columns: {sorted(set(table.column_names) ^ set(CLIENT_SCHEMA.names))}")
        table = table.select(CLIENT_SCHEMA.names).cast(CLIENT_SCHEMA)
        conform(spark.createDataFrame(table)).write.mode("append").parquet(path)
        empty = False
    schema = ", ".join(f"`{name}` {kind}" for name, kind in EXACT_TYPES.items())
    return spark.createDataFrame([], schema) if empty else spark.read.schema(schema).parquet(path)


def arrow_batches(frame: DataFrame, rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The rows of a frame, a batch of at most ``rows`` at a time, in no order.

    Tasks turn their rows into Arrow batches and write them out; the client then fetches one file at a
    time, and a file holds one batch.  So the driver's memory is bounded by a batch, whatever
    the size of the result, and nothing is computed twice.
    """
    spark = frame.sparkSession
    path = fresh_path(spark, "handover")

    def packed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                piece = batch.slice(start, rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema) as stream:
                    stream.write_batch(piece)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["piece"])

    frame.mapInArrow(packed, "piece binary").write.option("maxRecordsPerFile", 1).parquet(path)
    files = [row["file"] for row in spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct().toLocalIterator()]
    for file in sorted(files):
        for row in spark.read.parquet(file).toLocalIterator():
            with pa.ipc.open_stream(row["piece"]) as stream:
                yield from stream
