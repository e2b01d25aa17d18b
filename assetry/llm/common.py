"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assetry.llm.tokens import word_encoder
from assetry.session import ship_package
from assetry.sources.tables import materialized, shared_folder

# Rows handled at once inside a task, so that a batch of long texts stays small.
SLICE = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and read it back."""
    return materialized(df, name)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs: it does so once
    their objects on the driver are collected as garbage.  The last job's are held by
    the events about its end for a moment, hence the pause."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def row_key(*names: str):
    """64-bit key of a row's content, never null; equal rows share it."""
    return F.xxhash64(*names)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that is not taken, whatever the case of its letters."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def byte_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text in UTF-8, none for null: `bytes.split()`
    splits at \\x20 and \\x09-\\x0D only."""
    return text.encode().split() if text else []


@lru_cache(1)
def _c_library() -> ctypes.CDLL | None:
    """The C library, where it can trim its heap (glibc)."""
    try:
        library = ctypes.CDLL(None)
        library.malloc_trim  # noqa: B018
        return library
    except (OSError, AttributeError, TypeError):
        return None


def trim() -> None:
    """Return freed memory to the system; the C library keeps it else, also while
    this Python worker waits for its next task."""
    if _c_library():
        _c_library().malloc_trim(0)


_cleared: int | None = None  # the last task of this process that began with `give_back`


def give_back(keep_encoder: bool = False) -> None:
    """At the start of a task, or of the work on a group: let this Python worker return
    freed Arrow buffers to the system at once, which the usual pool keeps, and, once for
    a task, let go what tasks of other operators have left in the process.  Tasks that
    encode go on with its encoder."""
    global _cleared
    from pyspark import TaskContext

    pa.set_memory_pool(pa.system_memory_pool())
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if task is None or task != _cleared:
        _cleared = task
        if not keep_encoder:
            word_encoder.cache_clear()
        trim()


def trimmed(turn: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`turn`, the work on a group, between `give_back` and `trim`."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        try:
            return turn(table)
        finally:
            trim()

    return run


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    schema: str,
    keep: bool = False,
    encodes: bool = False,
) -> DataFrame:
    """`make()` runs once per task and gives the function that turns a slice of
    rows into columns (name -> array); the slices stream.  With `keep` the columns
    follow those of `df`, of which any with the same names are left out.  With
    `encodes` the tasks go on with the word encoder of their process."""
    arrow = arrow_schema(schema)
    target: str | StructType = schema
    if keep:
        df = df.drop(*arrow.names)
        target = StructType([*df.schema.fields, *StructType.fromDDL(schema).fields])
    kept = df.columns if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(encodes)
        turn = make()
        for batch in batches:
            for part in slices(batch):
                out = turn(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(kept))]
                    + [as_array(out[f.name], f.type) for f in arrow],
                    names=[*kept, *arrow.names],
                )
        del turn
        trim()

    return df.mapInArrow(run, target)


_KINDS = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow's form of a "name type, ..." schema; works on executors too."""
    return pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in schema.split(","))])


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, type=kind)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI (file, hdfs, s3, ...) or a local path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class WordHashes(dict):
    """64-bit hash of each word as 8 bytes, computed once per word and task.
    Emptied when full: it is a cache, not a table."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh64_digest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype="<u8")


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(a: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    a = a ^ (a >> np.uint64(31))
    a *= _M2
    a ^= a >> np.uint64(29)
    return a


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two adjacent runs from the hashes of both; order matters."""
    return mixed(left * _M1 + (right ^ (right >> np.uint64(17))))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` adjacent values, by doubling run lengths; runs
    that overlap in the last step still cover every word of the window."""
    if len(words) < size:
        return words[:0]
    runs, length = words, 1
    while length * 2 <= size:
        runs = joined_hash(runs[:-length], runs[length:])
        length *= 2
    if length < size:
        shift = size - length
        runs = joined_hash(runs[: len(runs) - shift], runs[shift:])
    return runs
