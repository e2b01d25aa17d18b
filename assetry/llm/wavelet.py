"""Token ids in wavelet matrices, one compressed file per shard.

A wavelet matrix keeps a row of ids as bit planes, highest bit first; each plane
orders the row by the bits before it, zeros ahead of ones.  With the number of
ones up to a place (rank) and the place of the n-th one (select) a file answers:
which id stands at i, how often does an id occur in a range, and where, without
unpacking the row.

File: header (see `_HEADER`), then the document table (null flags, ids and starts
of the documents, compressed), then for each plane its blocks, each compressed for
itself.  The index at the end has the offset of each block and the ones before it,
so a query unpacks one block per plane and step.
"""

from __future__ import annotations

import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetry.llm.common import arrow_schema, batch_of, give_back, new_folder, open_store, row_key, saved, slices
from assetry.llm.tokens import tokenizer_path, word_encoder

END_OF_DOCUMENT = 2
SHARD_TOKENS = 1 << 22  # a shard is closed after the document that reaches this
BLOCK_BITS = 1 << 18
_HEADER = struct.Struct("<8sIIQQQQ")  # magic, planes, 0, ids, documents, table's size, index's offset
_MAGIC = b"WAVELET1"
SHARDS = "task int, shard int, path string, n_docs long, n_tokens long, bytes long"
_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def planes_of(ids: np.ndarray) -> int:
    return max(1, int(ids.max()).bit_length()) if len(ids) else 1


def build(ids: np.ndarray) -> list[np.ndarray]:
    """Bits of each plane, packed."""
    n_planes = planes_of(ids)
    row = ids.astype(np.uint16 if n_planes <= 16 else np.uint32)
    planes = []
    for bit in range(n_planes - 1, -1, -1):
        ones = (row & row.dtype.type(1 << bit)).astype(bool)
        planes.append(np.packbits(ones, bitorder="little"))
        above = np.compress(ones, row)
        np.compress(~ones, row, out=(following := np.empty_like(row))[: len(row) - len(above)])
        following[len(row) - len(above) :] = above
        row = following
    return planes


def shard_bytes(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """The file of one shard: ids, and the documents with their first places."""
    pack = zstandard.ZstdCompressor(level=1).compress
    table = pack(
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
        + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
        + starts.astype("<u8").tobytes()
    )
    planes, index = build(ids), []
    parts, at = [table], _HEADER.size + len(table)
    for plane in planes:
        ones = 0
        for b in range(0, max(1, len(plane)), BLOCK_BITS // 8):
            block = plane[b : b + BLOCK_BITS // 8]
            packed = pack(block.tobytes())
            index.append((at, ones))
            parts.append(packed)
            at += len(packed)
            ones += int(_ONES[block].sum(dtype=np.int64))
        index.append((at, ones))  # end of the plane
    header = _HEADER.pack(_MAGIC, len(planes), 0, len(ids), len(doc_ids), len(table), at)
    return b"".join([header, *parts, np.array(index, dtype="<u8").tobytes()])


class Shard:
    """Reads one file; blocks are unpacked when they are asked for."""

    def __init__(self, path: str, blocks: int = 256):
        store, inner = open_store(path)
        self.file = store.open_input_file(inner)
        magic, self.planes, _, self.n, n_docs, size, index = _HEADER.unpack(self._at(0, _HEADER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a wavelet matrix")
        table = zstandard.ZstdDecompressor().decompress(self._at(_HEADER.size, size))
        nulls = np.frombuffer(table, np.uint8, n_docs)
        ids = np.frombuffer(table, "<i8", n_docs, n_docs)
        self.doc_ids = [None if x else i for x, i in zip(nulls.tolist(), ids.tolist())]
        self.starts = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.per_plane = max(1, -(-self.n // BLOCK_BITS)) + 1
        self.index = np.frombuffer(
            self._at(index, 16 * self.planes * self.per_plane), "<u8"
        ).reshape(self.planes, self.per_plane, 2).astype(np.int64)
        self.zeros = self.n - self.index[:, -1, 1]
        self.block = lru_cache(blocks)(self._block)

    def close(self) -> None:
        self.file.close()

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, plane: int, k: int) -> np.ndarray:
        at, end = int(self.index[plane, k, 0]), int(self.index[plane, k + 1, 0])
        data = zstandard.ZstdDecompressor().decompress(self._at(at, end - at))
        return np.frombuffer(data, np.uint8)

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        k, rest = divmod(i, BLOCK_BITS)
        ones = int(self.index[plane, k, 1])
        if rest:
            data, whole = self.block(plane, k), rest // 8
            ones += int(_ONES[data[:whole]].sum(dtype=np.int64))
            if rest % 8:
                ones += int(_ONES[data[whole] & ((1 << rest % 8) - 1)])
        return ones

    def _select(self, plane: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) such bit of a plane."""
        ends = np.minimum(np.arange(self.per_plane) * BLOCK_BITS, self.n)
        before = self.index[plane, :, 1] if bit else ends - self.index[plane, :, 1]
        k = int(np.searchsorted(before, nth, side="right")) - 1
        data = self.block(plane, k)
        bits = np.unpackbits(data, bitorder="little", count=int(ends[k + 1] - ends[k]))
        return k * BLOCK_BITS + int(np.flatnonzero(bits == bit)[nth - int(before[k])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            k, rest = divmod(i, BLOCK_BITS)
            bit = self.block(p, k)[rest // 8] >> (rest % 8) & 1
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _narrowed(self, token: int, low: int, high: int) -> tuple[int, int]:
        if token < 0 or token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self._ones(p, low), self._ones(p, high)
            if token >> (self.planes - 1 - p) & 1:
                low, high = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id at places low to high (excluded)."""
        low, high = self._narrowed(token, low, self.n if high is None else high)
        return high - low

    def occurrence(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of an id."""
        low, high = self._narrowed(token, 0, self.n)
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        at = low + nth
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            at = self._select(p, bit, at - int(self.zeros[p]) if bit else at)
        return at

    def _bits(self, plane: int) -> np.ndarray:
        data = np.concatenate([self._block(plane, k) for k in range(self.per_plane - 1)])
        return np.unpackbits(data, bitorder="little", count=self.n)

    def occurrences(self, token: int) -> np.ndarray:
        """Places of all occurrences of an id, ascending: the range that it has below the last
        plane is taken up plane by plane."""
        low, high = self._narrowed(token, 0, self.n)
        at = np.arange(low, high)
        for p in range(self.planes - 1, -1, -1):
            if not len(at):
                break
            bit = token >> (self.planes - 1 - p) & 1
            at = np.flatnonzero(self._bits(p) == bit)[at - int(self.zeros[p]) if bit else at]
        return np.sort(at)

    def ids(self) -> np.ndarray:
        """The whole row, put together from the last plane up."""
        row = np.zeros(self.n, dtype=np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            ones = self._bits(p).view(bool)
            above, z = np.empty_like(row), int(self.zeros[p])
            above[~ones] = row[:z]
            above[ones] = row[z:] | row.dtype.type(1 << (self.planes - 1 - p))
            row = above
        return row


def write(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    end_id: int = END_OF_DOCUMENT,
    shard_tokens: int = SHARD_TOKENS,
    whole_texts: bool = False,
) -> DataFrame:
    """Encode `docs` (doc_id, text) in ascending doc_id order, the end id after
    each, into shard files below `folder` (default: a new one in the shared
    folder); returns the table of shards: task and shard number (their order is
    the documents'), path, documents, ids and size.

    Null ids come first; rows of one id are ordered by a hash of the text.  A null
    or empty text has the end id alone.  Other columns are not read.  An empty
    table gives no shard.  A task writes each file whole under a name of its own
    attempt, and only the committed attempts' names get into the table, so lost
    executors leave unnamed files at worst.
    """
    folder = folder or new_folder(docs.sparkSession, "wavelet")
    path = tokenizer or tokenizer_path()
    arrow = arrow_schema(SHARDS)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        give_back(keep_encoder=True)
        task, shard = TaskContext.get().partitionId(), 0
        encoder = word_encoder(path, whole_texts)
        doc_ids, rows, size = [], [], 0

        def close():
            nonlocal doc_ids, rows, size, shard
            lengths = np.array([len(r) // 4 for r in rows], dtype=np.int64)
            joined, rows = b"".join(rows), []
            data = shard_bytes(np.frombuffer(joined, dtype="<u4"), doc_ids, np.cumsum(lengths) - lengths)
            name = f"{folder}/{task:06}-{shard:06}-{uuid.uuid4().hex}.wavelet"
            store, inner = open_store(name)
            store.create_dir(inner.rpartition("/")[0], recursive=True)
            with store.open_output_stream(inner) as out:
                out.write(data)
            row = (task, shard, name, len(doc_ids), size, len(data))
            doc_ids, size, shard = [], 0, shard + 1
            return batch_of(arrow, [row])

        for batch in batches:
            for part in slices(batch, 128):
                ids = encoder.encode_batch(part.column("text").to_pylist())
                for doc_id, one in zip(part.column("doc_id").to_pylist(), ids):
                    doc_ids.append(doc_id)
                    rows.append(one + end)
                    size += len(one) // 4 + 1
                    if size >= shard_tokens:
                        yield close()
        if doc_ids:
            yield close()

    ordered = (
        docs.select("doc_id", "text", row_key("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return saved(ordered.mapInArrow(run, SHARDS), "wavelet-shards")


def with_starts(shards: DataFrame) -> DataFrame:
    """Add `start`, the ids of all shards before: sums per task first, then along
    the tasks (one row each), then within a task."""
    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("of_task"))
    along = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.select("task", F.coalesce(F.sum("of_task").over(along), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return (
        shards.withColumn("inner", inner)
        .join(before, "task")
        .select("*", (F.col("before") + F.col("inner")).alias("start"))
        .drop("before", "inner")
    )


def read(shards: DataFrame) -> DataFrame:
    """Documents of shard files: (doc_id, start, n_tokens, ids), `start` the ids of
    all documents before, `ids` unsigned 32-bit little-endian.  A shard is read by
    one task, and its documents stream out in groups.  Where shards are small, a task
    reads several: half a full shard's ids each, or a task for each core."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    arrow = arrow_schema(schema)

    def run(batches):
        give_back()
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                ids = shard.ids()
                ends = np.append(shard.starts[1:], shard.n)
                for a in range(0, len(ends), 1024):
                    own = slice(a, a + 1024)
                    begins, stops = shard.starts[own], ends[own]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.doc_ids[own], pa.int64()),
                            pa.array(begins + start),
                            pa.array(stops - begins),
                            pa.array(
                                [ids[b:e].astype("<u4").tobytes() for b, e in zip(begins, stops)],
                                pa.binary(),
                            ),
                        ],
                        schema=arrow,
                    )
                shard.close()

    n, n_tokens = shards.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    cores = shards.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(n, max(cores, -(-2 * n_tokens // SHARD_TOKENS))))
    return with_starts(shards).select("path", "start").repartition(n).mapInArrow(run, schema)


def _of_shards(shards: DataFrame, work, schema: str) -> DataFrame:
    """Rows that `work` makes of each opened shard and its start."""
    arrow = arrow_schema(schema)

    def run(batches):
        give_back()
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(path)
                for columns in work(shard, start):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
                    )
                shard.close()

    return with_starts(shards).select("path", "start").repartition("path").mapInArrow(run, schema)


def count(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each of the given ids in all shards, by rank alone; a token that
    does not occur has 0.  The ids are a parameter, not a table."""
    asked = list(dict.fromkeys(tokens))

    def work(shard, _):
        yield asked, [shard.count(t) for t in asked]

    found = _of_shards(shards, work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    wanted = shards.sparkSession.createDataFrame([(t,) for t in asked], "token long")
    return wanted.join(found, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, place, position) of every occurrence of an id, by select: its place in its
    document, and among all ids."""

    def work(shard, start):
        at = shard.occurrences(token)
        for k in range(0, len(at), 1 << 16):
            own = at[k : k + (1 << 16)]
            doc = np.searchsorted(shard.starts, own, side="right") - 1
            yield [shard.doc_ids[d] for d in doc.tolist()], own - shard.starts[doc], own + start

    return _of_shards(shards, work, "doc_id long, place long, position long")


def access(shards: DataFrame, positions: DataFrame) -> DataFrame:
    """(position, token) for a table of positions among all ids; null where there is no such
    place.  Repeated positions give a row each.

    A shard covers few stretches of a fixed length, so positions find theirs by the number of
    their stretch; the rows of a shard are read in one opening.
    """
    span = SHARD_TOKENS
    first, last = F.expr(f"start div {span}"), F.expr(f"(start + n_tokens - 1) div {span}")
    covered = with_starts(shards).where("n_tokens > 0").select(
        "path", "start", "n_tokens", F.explode(F.sequence(first, last)).alias("stretch")
    )
    asked = positions.select(F.col("position").cast("long").alias("position"))
    asked = asked.withColumn("stretch", F.expr(f"position div {span}"))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))
    found = asked.join(covered, (asked["stretch"] == covered["stretch"]) & inside, "left")
    schema = "position long, token long"
    arrow = arrow_schema(schema)

    def run(batches):
        give_back()
        path, shard = None, None
        for batch in batches:
            tokens = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("path", "start", "position")])
            for own, start, position in rows:
                if own != path:
                    if shard:
                        shard.close()
                    path, shard = own, Shard(own) if own else None
                tokens.append(shard.access(position - start) if shard else None)
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(tokens, pa.int64())], schema=arrow)
        if shard:
            shard.close()

    dealt = found.select("path", "start", "position").repartition("path").sortWithinPartitions("path", "position")
    return dealt.mapInArrow(run, schema)
