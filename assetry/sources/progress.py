"""Progress logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetry.functions.paths import progress_message, progress_ratio

LOG_SCHEMA = (
    "name string, created double, step int, total int, original_message string, "
    "message string, progress double"
)
# Fixed value: state reported when there is no log.
UNKNOWN = (1.0, "unknown state")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Log records, one per JSON line."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def with_message(records: DataFrame, step: Column, total: Column, text: Column) -> DataFrame:
    """Add the share done and the message text of each record."""
    return records.withColumn("progress", progress_ratio(step, total)).withColumn(
        "message", progress_message(step, total, text)
    )


def latest_progress(records: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """Last record of each log."""
    return (
        records.groupBy(key)
        .agg(F.max_by(F.struct(*columns), order).alias("_last"))
        .select(key, "_last.*")
    )


def current_state(records: DataFrame) -> DataFrame:
    """Progress and message of the newest record, or the unknown state."""
    newest = F.max_by(F.struct("progress", "message"), F.col("created"))
    return records.agg(newest.alias("s")).select(
        F.coalesce("s.progress", F.lit(UNKNOWN[0])).alias("progress"),
        F.coalesce("s.message", F.lit(UNKNOWN[1])).alias("message"),
    )
