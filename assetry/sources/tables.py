"""Intermediate tables kept in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; on a local master with none set,
    as in tests, a temporary folder made once per application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a shared folder.")
        # the setting itself is fixed once a session runs
        own = context.applicationId
        if own not in _own_folders:
            _own_folders[own] = tempfile.mkdtemp(prefix="assetry-")
        folder = _own_folders[own]
    return folder.rstrip("/")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back.

    Cuts the lineage with a table that survives lost executors, and lets every
    later pass prune its columns and push its filters into Parquet.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs, which it does once their
    objects on the driver are collected as garbage.  The last job's are held by the events about
    its end for a moment, hence the pauses."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


class Buckets:
    """A table in folders `bucket=0`, `bucket=1`, ..., not all of which need be there."""

    def __init__(self, spark: SparkSession, folders: dict[int, str], schema: StructType):
        self.spark, self.folders, self.schema = spark, folders, schema

    def of(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of some buckets, by default of all."""
        paths = [f for b, f in sorted(self.folders.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def numbered(self) -> DataFrame:
        """All rows with their `bucket`."""
        number = F.regexp_extract(F.col("_metadata.file_path"), "/bucket=([0-9]+)/[^/]+$", 1)
        rows = self.of()
        if not self.folders:
            return rows.withColumn("bucket", F.lit(0))
        return rows.withColumn("bucket", number.cast("int"))

    def sizes(self) -> dict[int, int]:
        """Bytes of each bucket."""
        found = {}
        for b, folder in self.folders.items():
            place, fs = _file_system(self.spark, folder)
            found[b] = fs.getContentSummary(place).getLength()
        return found


def write_buckets(rows: DataFrame, folder: str, order: Sequence[str]) -> None:
    """Add rows to a table in buckets: in partitions of one size, so that a huge bucket is split
    and small ones share a task, each sorted so that like rows lie together."""
    rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
    rows.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(folder)


def buckets_in(spark: SparkSession, folder: str) -> dict[int, str]:
    """Folders of the buckets below a folder, by number."""
    made = [n for n in names_in(spark, folder) if n.startswith("bucket=")]
    return {int(n[7:]): f"{folder}/{n}" for n in made}


class Scratch:
    """Tables of one job in a folder of their own, which is removed at the end of the job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
        self._made: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._remove(self.folder)

    def _remove(self, path: str) -> None:
        place, fs = _file_system(self.spark, path)
        fs.delete(place, True)

    def path(self, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4()}"
        self._made.append(path)
        return path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """As `materialized`."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def before_turn(self, turns: int) -> int:
        """Before one of several turns, what earlier jobs left in shuffle files goes.  The place from
        which the turn's tables are to be cleared."""
        if turns > 1:
            let_go(self.spark)
        return len(self._made)

    def clear(self, since: int) -> None:
        """Remove the tables made since a place."""
        for path in self._made[since:]:
            self._remove(path)
        del self._made[since:]


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's entries; none if there is no such folder."""
    place, fs = _file_system(spark, folder)
    if not fs.exists(place):
        return []
    return [status.getPath().getName() for status in fs.listStatus(place)]


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, such as a manifest."""
    place, fs = _file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small text file; False, and nothing written, if it is already there."""
    place, fs = _file_system(spark, path)
    fs.mkdirs(place.getParent())
    try:
        stream = fs.create(place, False)
    except Py4JJavaError as e:
        if fs.exists(place):
            return False
        raise e
    stream.write(bytearray(text.encode()))
    stream.close()
    return True
