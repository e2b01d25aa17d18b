"""Merkle manifest of a table of documents, and proofs for many leaves at once.

Each source has a tree of 16 children a node over its documents, and the roots of
the sources have such a tree of their own.  A node is known by its coordinate:
(tree, level, index), tree being the rank of the source, or `TOP`.

Proofs are made as an octopus multiproof.  The leaves lie in blocks of neighbours.
A block first names the least set of nodes that it can't derive of its own leaves
(`missing`), those of all blocks are fetched by one join, then the block derives the
inner nodes that its leaves share, and every leaf's proof is read off them.

Texts are hashed where they are read and never move; what is shuffled are digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetry.llm.common import arrow_schema, give_back, saved

FAN = 16
STEP = 3  # levels that are built in one pass
BLOCK = FAN**STEP  # leaves of a block
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, level long, idx long, n long, digest string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def field_text(name: str, value: Column | None = None) -> Column:
    """A field as it enters a leaf: its size in bytes, a colon and itself; `-` for null."""
    value = (F.col(name) if value is None else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row, with another text if one is given."""
    return F.sha2(F.concat(*[field_text(n, text if n == "text" else None) for n in FIELDS]), 256)


def chosen_for_tampering() -> Column:
    """5 divides crc32(doc_id in decimal); never for a null id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(False))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows in `order` (nulls first) with their place in it as `name`, from 0.  No task sees
    more than a range of them: ranges count their rows, and start where those before end."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = saved(
        ranged.withColumns(
            {
                "part_": F.spark_partition_id(),
                "place_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
            }
        ),
        "merkle-places",
    )
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part_").agg(F.count("*").alias("rows_"))
    starts = starts.select("part_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("start_"))
    # one row for each partition of the table
    return (
        placed.join(F.broadcast(starts), "part_")
        .withColumn(name, F.col("start_") + F.col("place_"))
        .drop("part_", "place_", "start_")
    )


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of each key from a stream in which those of a key are neighbours."""
    key, held = None, {}
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        rows = list(zip(*[columns[k] for k in keys]))
        at = 0
        while at < len(rows):
            end = at + 1
            while end < len(rows) and rows[end] == rows[at]:
                end += 1
            if rows[at] != key:
                if held:
                    yield key, held
                key, held = rows[at], {n: [] for n in columns}
            for n, c in columns.items():
                held[n] += c[at:end]
            at = end
    if held:
        yield key, held


def up(digests: list[str], first: int, n: int, levels: int = STEP) -> Iterator[tuple[int, int, int, list[str]]]:
    """Levels above a row of neighbours, which begins a run and has `n` nodes in the whole
    tree: (level above it, index of the first node, nodes of the level, digests)."""
    for above in range(1, levels + 1):
        if n == 1:
            return
        digests = [hashed("".join(digests[i : i + FAN]).encode()) for i in range(0, len(digests), FAN)]
        first, n = first // FAN, -(-n // FAN)
        yield above, first, n, digests


def climbed(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The tables of all levels above `nodes`, some levels in each.  Chunks of `BLOCK`
    neighbours are sorted together and built in one stream."""
    arrow = arrow_schema(NODES)

    def run(batches):
        give_back()
        for (tree, _), rows in groups(batches, ["tree", "chunk"]):
            level = rows["level"][0]
            for above, first, n, made in up(rows["digest"], rows["idx"][0], rows["n"][0]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * len(made), pa.int64()),
                        pa.array([level + above] * len(made), pa.int64()),
                        pa.array(np.arange(first, first + len(made))),
                        pa.array([n] * len(made), pa.int64()),
                        pa.array(made),
                    ],
                    schema=arrow,
                )

    tables, level = [], 0
    while largest > 1:
        chunked = nodes.where("n > 1").withColumn("chunk", F.expr(f"idx div {BLOCK}"))
        ordered = chunked.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")
        tables.append(saved(ordered.mapInArrow(run, NODES), "merkle-nodes"))
        largest, level = -(-largest // BLOCK), level + STEP
        nodes = tables[-1].where(F.col("level") == level)
    return tables


@dataclass(frozen=True)
class Manifest:
    """leaves: doc_id, source, leaf, tampered (the other leaf, if any), rank and number of
    leaves of the source, pos in it, place in the whole; nodes: coordinates with digests and
    the number of nodes on their level."""

    leaves: DataFrame
    nodes: DataFrame
    n_sources: int


def build(docs: DataFrame) -> Manifest:
    """The manifest of a table with the columns `FIELDS`; other columns are not read.

    Sources stand in UTF-8 order, null first; leaves by doc_id, null first, and of several
    rows of one id by digest.  Every repeated row is a leaf of its own.  An empty table gives
    empty tables.
    """
    changed = F.when(chosen_for_tampering(), leaf(F.translate("text", _UPPER, _LOWER)))
    plain = saved(
        docs.select(
            "doc_id",
            "source",
            leaf().alias("leaf"),
            changed.alias("tampered"),
            # tells equal rows apart, so that a range may end between them
            F.monotonically_increasing_id().alias("row_"),
        ),
        "merkle-leaves",
    )
    placed = numbered(plain, ["source", "doc_id", "leaf", "row_"], "place").drop("row_")
    sources = placed.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ranked = saved(numbered(sources, ["first"], "rank"), "merkle-sources")
    totals = ranked.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
    same = placed["source"].eqNullSafe(ranked["source"])
    leaves = saved(
        placed.join(ranked.select("source", "first", "n", "rank"), same)
        .select(
            "doc_id",
            placed["source"],
            "leaf",
            "tampered",
            "rank",
            "n",
            (F.col("place") - F.col("first")).alias("pos"),
            "place",
        ),
        "merkle-leaves",
    )
    nodes = leaves.select(
        F.col("rank").alias("tree"), F.lit(0).cast("long").alias("level"), F.col("pos").alias("idx"), "n",
        F.col("leaf").alias("digest"),
    )
    tables = [nodes, *climbed(nodes, totals.n or 0)]
    subroots = [
        t.where("n = 1").select(
            F.lit(TOP).cast("long").alias("tree"), F.lit(0).cast("long").alias("level"),
            F.col("tree").alias("idx"), F.lit(totals.k).cast("long").alias("n"), "digest",
        )
        for t in tables
    ]
    tops = saved(united(subroots), "merkle-subroots")
    tables += [tops, *climbed(tops, totals.k)]
    return Manifest(leaves, united(tables), totals.k)


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def missing(known: Iterable[int], n: int) -> Iterator[tuple[int, list[int]]]:
    """The least set of nodes that the path from the `known` leaves to the top of a tree of `n`
    leaves asks for and that can't be derived of them: per level, the others of each run."""
    known, level = np.unique(np.fromiter(known, dtype=np.int64)), 0
    while n > 1:
        runs = np.unique(known // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(members[members < n], known, assume_unique=True).tolist()
        known, n, level = runs, -(-n // FAN), level + 1


class Paths:
    """All nodes of one tree on the paths of some leaves: its own ones and fetched ones."""

    def __init__(self, known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]):
        self.runs: list[dict[int, bytes]] = []  # per level: a run's digests in a row
        level = 0
        while n > 1:
            runs = {}
            for run in {i // FAN for i in known}:
                first = run * FAN
                members = [
                    known[i] if i in known else fetched[level, i] for i in range(first, min(first + FAN, n))
                ]
                runs[run] = "".join(members).encode()
            self.runs.append(runs)
            known, n, level = {r: hashed(d) for r, d in runs.items()}, -(-n // FAN), level + 1
        (self.root,) = known.values()
        self._above: dict[tuple[int, int], bytes] = {}

    def siblings(self, idx: int, level: int = 0) -> tuple[bytes, bytes]:
        """Digests of the run of a node, left and right of it."""
        run, at = self.runs[level][idx // FAN], idx % FAN * 64
        return run[:at], run[at + 64 :]

    def above(self, idx: int, level: int = 1) -> bytes:
        """All siblings from a level to the top, for node `idx` of it."""
        if level >= len(self.runs):
            return b""
        found = self._above.get((level, idx))
        if found is None:
            left, right = self.siblings(idx, level)
            found = self._above[level, idx] = left + right + self.above(idx // FAN, level + 1)
        return found

    def fold(self, digest: str, idx: int) -> str:
        """The root that a leaf and the siblings give."""
        for level in range(len(self.runs)):
            left, right = self.siblings(idx, level)
            digest, idx = hashed(left + digest.encode() + right), idx // FAN
        return digest


PROOFS = (
    "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def prove(manifest: Manifest, chosen: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Proof and verdict of each leaf, or of those for which `chosen`, a condition on the
    leaves' columns, holds: the leaf, the roots, the digest of all siblings from the leaf to the
    root, and the root that the tampered leaf (the leaf itself where there is none) folds to.
    """
    leaves = manifest.leaves if chosen is None else manifest.leaves.where(chosen)
    leaves = leaves.withColumn("block", F.expr(f"place div {block}"))
    n_sources = manifest.n_sources
    want = arrow_schema("block long, tree long, level long, idx long")

    def names(key, table):
        asked = []
        own: dict[tuple[int, int], list[int]] = {}
        for rank, n, pos in zip(*[table.column(c).to_pylist() for c in ("rank", "n", "pos")]):
            own.setdefault((rank, n), []).append(pos)
        for (rank, n), places in own.items():
            asked += [(rank, level, i) for level, ids in missing(places, n) for i in ids]
        top = 0
        for level, ids in missing([r for r, _ in own], n_sources):
            asked += [(TOP, level, i) for i in ids]
            top = level + 1
        asked.append((TOP, top, 0))  # the root to compare with
        columns = [[key[0].as_py()] * len(asked), *zip(*asked)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=want)

    wanted = leaves.select("block", "rank", "n", "pos").groupBy("block").applyInArrow(
        names, "block long, tree long, level long, idx long"
    )
    nodes = manifest.nodes.select("tree", "level", "idx", "digest")
    fetched = wanted.join(nodes, ["tree", "level", "idx"]).select("block", "tree", "level", "idx", "digest")
    out = arrow_schema(PROOFS)

    def proofs(left, right):
        known: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, i, digest in zip(*[right.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")]):
            known.setdefault(tree, {})[level, i] = digest
        rows = left.to_pylist()
        own: dict[tuple[int, int], dict[int, str]] = {}
        for r in rows:
            own.setdefault((r["rank"], r["n"]), {})[r["pos"]] = r["leaf"]
        trees = {rank: Paths(leaf_at, n, known.get(rank, {})) for (rank, n), leaf_at in own.items()}
        tops = known[TOP]
        root = tops[max(tops)]  # nothing else is asked for on its level
        forest = Paths({rank: t.root for rank, t in trees.items()}, n_sources, tops)
        beyond = {}
        for rank in trees:
            near = b"".join(forest.siblings(rank)) if forest.runs else b""
            beyond[rank] = near + forest.above(rank // FAN)
        made = []
        for r in rows:
            rank, pos, tree = r["rank"], r["pos"], trees[r["rank"]]
            proof = hashlib.sha256()
            if tree.runs:
                before, after = tree.siblings(pos)
                proof.update(before)
                proof.update(after)
                proof.update(tree.above(pos // FAN))
            proof.update(beyond[rank])
            if r["tampered"] in (None, r["leaf"]):
                folded = forest.root  # what all leaves of the block share
            else:
                folded = forest.fold(tree.fold(r["tampered"], pos), rank)
            made.append(
                (r["doc_id"], r["source"], r["leaf"], tree.root, root, proof.hexdigest(), folded, folded == root)
            )
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    return leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(proofs, PROOFS)
