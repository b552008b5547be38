"""Streaming intake: the same extraction over arriving documents, tiers by window, and audit events without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fields, security

SCHEMA = "doc_id bigint, text string, ts timestamp"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of SCHEMA as they land in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def extracted(docs: DataFrame, patterns: dict[str, str], required: list[str]) -> DataFrame:
    """docs with a column for each field and the tier. Row by row, so it keeps no state and runs on streams and tables alike."""
    wide = fields.extract_wide(docs, patterns)
    missing = F.lit(False)
    for f in required:
        missing = missing | F.col(f).isNull()
    return wide.withColumn("tier", F.when(missing, "low").otherwise("high"))


def tier_windows(docs: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Documents by tumbling window and tier; windows close when the watermark has passed."""
    by = docs.withWatermark("ts", late).groupBy(F.window("ts", length), "tier").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("window.start").alias("window_start"), "tier", "n")


def audit_stream(docs: DataFrame, event: str, late: str = "10 minutes") -> DataFrame:
    """An audit event for each content, once within the watermark."""
    events = security.audit_events(docs, event, F.col("ts"))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_hash", "event"])
