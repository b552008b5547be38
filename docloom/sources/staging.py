"""Tables computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the setting is missing and all runs in one process."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="docloom-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by key into partitions of about so many rows. Where few bytes are expanded into many rows, a task's work then doesn't grow with the table, and what is grouped by the key isn't moved again."""
    return df.repartition(max(-(-df.count() // rows), df.sparkSession.sparkContext.defaultParallelism), key)


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that several uses don't make it again and lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
