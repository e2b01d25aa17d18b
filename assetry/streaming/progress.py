"""Following progress logs as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetry.sources.progress import LOG_SCHEMA


def follow_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming table of the newest record of each log in a folder.

    State is one row per log.  Write it in `update` or `complete` mode.
    """
    return (
        spark.readStream.schema(LOG_SCHEMA)
        .json(folder)
        .groupBy("name")
        .agg(F.max_by(F.struct("created", "progress", "message"), "created").alias("_last"))
        .select("name", "_last.*")
    )
