"""Directory graph of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.functions import paths

# Colour of a directory, a valid asset and an invalid one.
NEUTRAL, VALID, INVALID = "#B6ECF3", "#A0D17B", "#DE958E"
ROOT = "root"


def asset_validity(catalog: DataFrame) -> DataFrame:
    """Validity of each asset path: that of its last file."""
    return (
        catalog.where(F.col("asset_path").isNotNull())
        .groupBy("asset_path")
        .agg(F.max_by("asset_valid", "filepath").alias("asset_valid"))
    )


def graph_nodes(catalog: DataFrame) -> DataFrame:
    """Every ancestor directory and every asset, once: id (`root` and the path),
    label (its last part), colour."""
    directory = F.lit(None).cast("boolean")
    above = F.transform(
        paths.ancestors(F.col("asset_path")),
        lambda d: F.struct(d.alias("node_id"), directory.alias("v")),
    )
    itself = F.array(F.struct(F.col("asset_path").alias("node_id"), F.col("asset_valid").alias("v")))
    nodes = asset_validity(catalog).select(F.inline(F.concat(above, itself)))
    return nodes.groupBy("node_id").agg(F.max("v").alias("v")).select(
        F.concat(F.lit(ROOT), "node_id").alias("node_id"),
        paths.file_name(F.col("node_id")).alias("label"),
        F.when(F.col("v"), F.lit(VALID))
        .when(~F.col("v"), F.lit(INVALID))
        .otherwise(F.lit(NEUTRAL))
        .alias("color"),
    )


def graph_edges(catalog: DataFrame) -> DataFrame:
    """Parent to child for every pair of neighbouring nodes."""
    return (
        graph_nodes(catalog)
        .select(
            paths.parent_path(F.col("node_id")).alias("source"),
            F.col("node_id").alias("target"),
        )
        .where(F.col("source") != ROOT)
    )
