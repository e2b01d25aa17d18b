"""Synthetic file listing derived from the `lineitem` table.

One file per distinct (order, line number, part number modulo 1000); one asset
per order.  The same arithmetic is written in SQL for the DuckDB check.  The
listing is a projection over one map-side-combined DISTINCT on three integers,
so no order, however many lines it has, is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "/ingress"
STAGING = "/staging"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the synthetic files: order, line and part numbers."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("ok"),
            F.col("l_linenumber").alias("ln"),
            (F.col("l_partkey") % 1000).cast("int").alias("pk"),
        )
        .distinct()
    )


_FACTS = """
    ok, ln, pk,
    get(array('spec001', 'spec001', 'spec001', 'spec002', 'spec002', 'vdb001',
              'raw009', 'none'), int(ok % 8)) AS spec,
    concat('proj', lpad(ok % 25 + 1, 3, '0')) AS proj,
    get(array('pizza', 'taco', 'kiwi', 'bagel'), int(ok % 4)) AS descr,
    lpad(if(ok % 8 = 5, ln, ok % 999 + 1), 3, '0') AS ver,
    pk % 50 AS bad
"""
_NAMES = """
    *,
    concat('/ingress/', proj, '/', spec, '/o', ok, CASE spec
        WHEN 'none' THEN ''
        WHEN 'vdb001' THEN concat('/k', pk)
        ELSE concat('/p-', proj, '_s-', spec, '_d-', descr, '_v', ver) END) AS directory,
    CASE WHEN spec = 'none' THEN concat('misc_', ln, '_', pk) ELSE concat(
        'p-', proj,
        '_s-', spec, if(bad = 3, '2', ''),
        '_d-', CASE bad WHEN 0 THEN upper(descr) WHEN 2 THEN 'other' ELSE descr END,
        '_v', if(bad = 1, substr(ver, 2), ver),
        if(spec = 'spec001', concat('_c000', pk % 2, '-000', ok % 3), ''),
        if(spec = 'vdb001', '', concat(if(bad = 4, '_g', '_f'), ln * 1000 + pk))
    ) END AS stem,
    get(array('png', 'png', 'png', 'jpg', 'jpg', 'vdb', 'jpg', 'txt'), int(ok % 8)) AS extension,
    spec IN ('spec001', 'spec002', 'raw009') AS is_image
"""
_LISTING = """
    concat(directory, '/', stem, '.', extension) AS filepath,
    concat(stem, '.', extension) AS filename,
    extension,
    if(is_image, if(pk % 41 = 0, 400, 4), NULL) AS width,
    if(is_image, 5, NULL) AS height,
    if(is_image, 3, NULL) AS channels,
    ok, ln, pk
"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filepath, filename, extension, plus the image traits `width`, `height`,
    `channels` (null for files that are not images) and the keys `ok`, `ln`, `pk`."""
    keys = file_keys(spark, sf_dir)
    return spark.sql(
        f"SELECT {_LISTING} FROM (SELECT {_NAMES} FROM (SELECT {_FACTS} FROM {{keys}}))",
        keys=keys,
    )
