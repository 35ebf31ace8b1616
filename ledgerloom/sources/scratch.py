"""Folders that the driver and all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for copies and intermediate tables; Spark removes it when the
    application ends.

    It lies below ``spark.checkpoint.dir``.  Where that is not set, only a session whose tasks run in
    the driver's own process falls back to its warehouse, which may be a local folder.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        master = context.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    folder = f"{base.rstrip('/')}/ledgerloom-{context.applicationId}"
    system, place = file_system(spark, folder)
    system.mkdirs(place)
    system.deleteOnExit(place)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
