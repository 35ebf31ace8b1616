"""What the operators of this subpackage share: reading, cutting lineage, mapping texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerloom.sources.scratch import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: its lineage ends here, and
    lost executors or repeated use do not compute it again."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of runs without white space (space, tab to carriage return); null counts 0.
    Each word with the white space behind it becomes one character, which is counted."""
    space = r"\x20\x09-\x0D"
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{space}]+", "")
    return F.char_length(F.regexp_replace(bare, rf"[^{space}]+[{space}]*", "x")).cast("bigint")


def over_texts(
    frame: DataFrame,
    carried: Sequence[str],
    text: str,
    schema: str,
    make: Callable[[], Callable[[list], list[Sequence]]],
    raw: bool = False,
) -> DataFrame:
    """Map every whole text of a frame in Arrow batches.

    ``make()`` is called once per task and returns a function from a list of texts (str,
    or UTF-8 bytes if ``raw``; null stays None) to one list per column of ``schema``.  It
    gets about ``CHUNK_CHARS`` at a time, one text at least, which bounds memory whatever
    the batch size.  The carried columns come through unchanged, in front; their names must
    differ from those of ``schema``.
    """
    apart = [] if text in carried else [F.col(f"`{text}`").alias("__text")]
    kept = frame.select(*[F.col(f"`{c}`") for c in carried], *apart)
    at = len(carried) if apart else list(carried).index(text)
    added = StructType.fromDDL(schema)
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(at)
            lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            if raw:
                column = column.cast(pa.binary())
            start = 0
            while start < batch.num_rows:
                stop, chars = start + 1, lengths[start]
                while stop < batch.num_rows and chars + lengths[stop] <= CHUNK_CHARS:
                    chars += lengths[stop]
                    stop += 1
                found = work(column.slice(start, stop - start).to_pylist())
                piece = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(i) for i in range(len(carried))]
                    + [pa.array(v, field.type) for v, field in zip(found, arrow, strict=True)],
                    [*carried, *added.names],
                )
                start = stop

    return kept.mapInArrow(run, StructType([*kept.schema.fields[: len(carried)], *added.fields]))
