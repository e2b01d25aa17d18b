"""Exact top-k search by inner product, in tiles.

Vectors are packed into shards, the queries into blocks.  Shards are dealt evenly to slots,
and every block is sent once to every slot, where it meets the shards one after the other: a
tile is one matrix product, of which each query keeps its k best.  A task holds the shards of
one slot, `GROUP` at most, and one block.  The lists of a block are merged along a tree over
the slots, so no task holds more than `FAN_IN` of them.  Nothing is broadcast but the numbers
of shards: the sizes of tables that are multiplied here are not what Spark takes them for.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import arrow_schema, batch_of, give_back, saved

SHARD = 8192  # vectors of a shard
QUERIES = 1024  # queries of a block
FAN_IN = 16
GROUP = 16  # shards of a slot
TASKS = 4  # slots of a core, if there are shards enough
SCALE = 64.0
_PACKED = "pack long, n int, dim int, ids binary, vectors binary"
_LISTS = "block long, node long, queries binary, counts binary, ids binary, scores binary"
_LEAST = np.iinfo(np.int64).min
_PARTITION = 32  # bits of a pack's number within the partition that made it


def _packed(vectors: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows of up to `size` vectors with components floor(scale * x), two bytes each where
    they are small."""
    arrow = arrow_schema(_PACKED)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << _PARTITION
        ids, rows = [], []

        def close():
            nonlocal ids, rows, number
            dim = max(map(len, rows))
            data = np.zeros((len(rows), dim))
            for i, r in enumerate(rows):
                data[i, : len(r)] = r
            kind = "<i2" if np.abs(data).max(initial=0) < 2**15 else "<f8"
            row = (number, len(rows), dim, np.array(ids, "<i8").tobytes(), data.astype(kind).tobytes())
            ids, rows, number = [], [], number + 1
            return batch_of(arrow, [row])

        for batch in batches:
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                values = x.values
                if values is None or values.null_count or vec_id is None:
                    continue
                v = np.floor(scale * np.asarray(values, dtype=np.float64))
                if not np.isfinite(v).all():
                    continue
                ids.append(vec_id)
                rows.append(v)
                if len(ids) == size:
                    yield close()
        if ids:
            yield close()

    return vectors.select("vec_id", "embedding").mapInArrow(run, _PACKED)


def _matrix(blob: bytes, n: int, dim: int, width: int) -> np.ndarray:
    out = np.zeros((n, width))
    kind = "<i2" if len(blob) == 2 * n * dim else "<f8"
    out[:, :dim] = np.frombuffer(blob, kind).reshape(n, dim)
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; beyond 64 bits they stay at the limit."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    limit = np.iinfo(np.int64)
    big = exact(q).dot(exact(x).T)
    return np.clip(big, limit.min + 1, limit.max).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k best of each row, best first, ties to the smaller id;
    columns must be in rising order of id."""
    k = min(k, scores.shape[1])
    masked = np.where(valid, scores, _LEAST)
    bound = np.partition(masked, -k, axis=1)[:, -k]
    out = []
    for row, least, ok in zip(masked, bound, valid):
        above = np.flatnonzero((row > least) & ok)
        equal = np.flatnonzero((row == least) & ok)[: k - len(above)]
        own = np.concatenate((above, equal))
        out.append(own[np.lexsort((ids[own], -row[own].astype(object) if least == _LEAST + 1 else -row[own]))])
    return out


def _lists_row(block: int, node: int, queries: np.ndarray, ids: list, scores: list) -> tuple:
    counts = np.array([len(i) for i in ids], "<i4")
    return (
        block, node, queries.astype("<i8").tobytes(), counts.tobytes(),
        np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(scores).astype("<i8").tobytes(),
    )


def _merged_lists(parts: list[tuple[list, list]], k: int) -> tuple[list, list]:
    """The k best of each query from its lists in several parts (ids, scores)."""
    if len(parts) == 1:
        return parts[0]
    ids, scores = [], []
    for own_ids, own_scores in zip(zip(*(p[0] for p in parts)), zip(*(p[1] for p in parts))):
        a, s = np.concatenate(own_ids), np.concatenate(own_scores)
        own = np.lexsort((a, -s))[:k]
        ids.append(a[own])
        scores.append(s[own])
    return ids, scores


def _tile(shard: dict, block: dict, queries: np.ndarray, k: int) -> tuple[list, list]:
    """ids and scores of the k best in a shard for each query of a block."""
    width = max(shard["dim"], block["dim"])
    ids = np.frombuffer(shard["ids"], "<i8")
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    x = _matrix(shard["vectors"], shard["n"], shard["dim"], width)[order]
    q = _matrix(block["vectors"], block["n"], block["dim"], width)
    found, scores = [], []
    for a in range(0, len(queries), 128):
        s = _products(q[a : a + 128], x)
        valid = ids[None, :] != queries[a : a + 128, None]
        for row, own in zip(s, best(s, ids, valid, k)):
            found.append(ids[own])
            scores.append(row[own])
    return found, scores


def _search_slots(k: int):
    """Rows of a slot come in order, its shards before the blocks."""
    arrow = arrow_schema(_LISTS)

    def run(batches):
        give_back()
        slot, shards = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                t = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if t["slot"] != slot:
                    slot, shards = t["slot"], []
                if not t["asks"]:
                    shards.append(t)
                    continue
                queries = np.frombuffer(t["ids"], "<i8")
                best_of = None
                for shard in shards:
                    found = _tile(shard, t, queries, k)
                    best_of = found if best_of is None else _merged_lists([best_of, found], k)
                if best_of is not None:
                    yield batch_of(arrow, [_lists_row(t["pack"], slot, queries, *best_of)])

    return run


def _merged(k: int):
    arrow = arrow_schema(_LISTS)

    def merge(key, table):
        import pyarrow as pa

        rows = table.to_pylist()
        queries = np.frombuffer(rows[0]["queries"], "<i8")
        parts = []
        for r in rows:
            ends = np.cumsum(np.frombuffer(r["counts"], "<i4"))[:-1]
            parts.append((
                np.split(np.frombuffer(r["ids"], "<i8"), ends),
                np.split(np.frombuffer(r["scores"], "<i8"), ends),
            ))
        row = _lists_row(key[0].as_py(), key[1].as_py(), queries, *_merged_lists(parts, k))
        return pa.Table.from_batches([batch_of(arrow, [row])])

    return merge


def _in_slots(shards: DataFrame) -> tuple[DataFrame, int]:
    """Shards with `slot`, each of which has `GROUP` of them at most; and the number of slots."""
    spark = shards.sparkSession
    part = F.shiftright("pack", _PARTITION)
    # one row for each partition that made shards
    made = shards.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    before, n = [], 0
    for r in sorted(made):
        before.append((r.part, n))
        n += r.n
    slots = max(1, min(n, max(TASKS * spark.sparkContext.defaultParallelism, -(-n // GROUP))))
    first = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    number = F.col("before") + F.col("pack").bitwiseAND((1 << _PARTITION) - 1)
    numbered = shards.withColumn("part", part).join(first, "part")
    return numbered.select(F.pmod(number, F.lit(slots)).cast("int").alias("slot"), *shards.columns), slots


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = SCALE) -> DataFrame:
    """The k best of `vectors` (vec_id, embedding) for each row of `queries` (same
    columns): (query_id, rank, vec_id, score), ranks from 1, ties to the smaller id.

    Components count as floor(scale * x); the score is their integer inner product.
    Rows with a null id, a null vector, or a null or non-finite component take no
    part; shorter vectors count as filled up with zeros.  A query's own row is left
    out, and with it rows that repeat its id; a repeated query has its list for each
    row, repeated vectors are candidates each.  Other columns are not read; empty
    tables give no rows.
    """
    shards = saved(_packed(vectors, SHARD, scale), "shards")
    blocks = saved(_packed(queries, QUERIES, scale), "query-blocks")
    dealt, slots = _in_slots(shards)
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    rows = dealt.withColumn("asks", F.lit(False)).unionByName(
        blocks.select(every, *blocks.columns, F.lit(True).alias("asks"))
    )
    rows = rows.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", "asks", "pack")
    lists = rows.mapInArrow(_search_slots(k), _LISTS)
    nodes = slots
    while True:
        nodes = -(-nodes // FAN_IN)
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN_IN))
        lists = lists.groupBy("block", "node").applyInArrow(_merged(k), _LISTS)
        if nodes == 1:
            break
    return lists.mapInArrow(_ranked, "query_id long, rank int, vec_id long, score long")


def _ranked(batches):
    arrow = arrow_schema("query_id long, rank int, vec_id long, score long")
    import pyarrow as pa

    for batch in batches:
        for r in batch.to_pylist():
            counts = np.frombuffer(r["counts"], "<i4")
            before = np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.frombuffer(r["queries"], "<i8"), counts)),
                    pa.array((np.arange(len(before)) - before + 1).astype(np.int32)),
                    pa.array(np.frombuffer(r["ids"], "<i8")),
                    pa.array(np.frombuffer(r["scores"], "<i8")),
                ],
                schema=arrow,
            )
