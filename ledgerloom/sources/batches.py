"""Appending to a stored ``sales`` table so that a repeated append changes nothing.

A batch has a name.  It is written aside, in a folder of its own that readers pass over, and
becomes part of the table by one rename to ``_batch=<name>``.  A task lost in the
middle is run again by Spark; an append that dies leaves only a pending folder that no reader
sees, and can be run again; one that succeeded before is not published twice, also when two
run at once, since the rename refuses a folder that is there.

Next to its rows a batch keeps their additive parts (sums, counts and sets of customers per product,
region, channel and month).  Analyses that only add up read them instead of the sales, so after
an append nothing but the new batch is summed.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.dates import month_start
from ledgerloom.functions.distinct import BITS, SET_COLUMNS, ored, word_columns
from ledgerloom.functions.parts import parts
from ledgerloom.sources.schema import conform
from ledgerloom.sources.scratch import file_system
from ledgerloom.sources.tables import read_sales, write_sales

BATCH = "_batch"
PENDING = "_pending"
KIND = "_kind"  # what a folder of a batch holds
ROWS, PARTS = "rows", "parts"
PART_KEYS = ("product", "region", "sales_channel", "month")
PART_MEASURES = ("total_amount", "quantity", "unit_price", "discount_percent")


def append_batch(sales: DataFrame, path: str, batch: str) -> bool:
    """Append the rows of a batch to the table at ``path``; false, and no change, if the table has the
    batch already.  ``batch`` is letters, digits, dots, dashes and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    spark = sales.sparkSession
    system, target = file_system(spark, f"{path}/{BATCH}={batch}")
    if system.exists(target):
        return False
    aside = f"{path}/{PENDING}/{batch}-{uuid.uuid4().hex}"
    write_sales(sales, f"{aside}/{KIND}={ROWS}")
    # from the rows as they were written, so that both agree whatever made them
    batch_parts(read_sales(spark, f"{aside}/{KIND}={ROWS}")).write.parquet(f"{aside}/{KIND}={PARTS}")
    return _published(spark, aside, target)


def _published(spark: SparkSession, aside: str, target) -> bool:
    """Rename a pending folder, unless there is one of the new name."""
    system, pending = file_system(spark, aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pending, target = system.makeQualified(pending), system.makeQualified(target)
    context = hadoop.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(pending, target, spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception:
        if not system.exists(target):
            raise
        system.delete(pending, True)  # another append of the same batch came first
        return False
    return True


def batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that the table has."""
    system, place = file_system(spark, path)
    if not system.exists(place):
        return []
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(name.removeprefix(f"{BATCH}=") for name in names if name.startswith(f"{BATCH}="))


def read_batches(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The sales of all batches, or of the named ones, with the batch's name as text."""
    return conform(_read(spark, path, names, ROWS))


def read_parts(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The additive parts of all batches, or of the named ones, not yet added up across batches."""
    return _read(spark, path, names, PARTS)


def _read(spark: SparkSession, path: str, names: tuple[str, ...], kind: str) -> DataFrame:
    chosen = [f"{path}/{BATCH}={name}/{KIND}={kind}" for name in names or batches(spark, path)]
    if not chosen:
        raise ValueError(f"no batch at {path}")
    return spark.read.option("basePath", path).parquet(*chosen).withColumn(BATCH, F.col(BATCH).cast("string")).drop(KIND)


def batch_parts(sales: DataFrame) -> DataFrame:
    """Parts of the measures per product, region, channel and month, and as further rows the set of
    customers per region; ``is_set`` tells them apart.  One read and one grouping make both."""
    words = word_columns("customer_id")
    kinds = dict(zip(words, ("bigint", "string", "bigint")))
    exact = conform(sales)
    types = dict(exact.dtypes)
    none = lambda kind: F.lit(None).cast(kind)
    keys = {"product": F.col("product"), "region": F.col("region"), "sales_channel": F.col("sales_channel"), "month": month_start("date")}
    measured = {"is_set": F.lit(False), **keys, **{n: none(k) for n, k in kinds.items()}, **{m: F.col(m) for m in PART_MEASURES}}
    in_set = {
        "is_set": F.lit(True), **{k: none("date" if k == "month" else "string") for k in keys}, "region": F.col("region"),
        **words, **{m: none(types[m]) for m in PART_MEASURES},
    }
    both = F.array(*[F.struct(*[columns[name].alias(name) for name in measured]) for columns in (measured, in_set)])
    rows = exact.select(F.inline(both)).where(~F.col("is_set") | F.col(BITS).isNotNull())
    return parts(rows, ["is_set", *keys, *SET_COLUMNS], PART_MEASURES, ored())
