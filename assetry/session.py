"""Session settings the jobs are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Runtime SQL settings.  Above 8000 bytes of byte code the JVM leaves a method
# uncompiled, so stages whose fused code would be larger run operator by operator.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    # recursive searches stop where their condition says, not at a number of rows
    "spark.sql.cteRecursionRowLimit": "-1",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as `--py-files` would, once per
    application.  Spark distributes the file; only the driver reads it here."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="assetry-code-"), "assetry.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, parent))
    context.addPyFile(archive)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session and ship the package."""
    ship_package(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and single-machine runs."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("assetry")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
