"""Near-duplicates by MinHash with tensored banding.

A banding of L tables of k hashes each needs L*k minhashes.  Here two small
collections A and B of m group hashes (k/2 minhashes each) are made, and table
(i, j) is keyed by the pair (A_i, B_j): m*m tables from 2*m*k/2 minhashes.  Two
sets of similarity s share a table if some A_i and some B_j agree, with
probability (1 - (1 - s^(k/2))^m)^2.  m follows from the threshold: 11 at 0.85 miss 6
of 100,000 pairs at the threshold, 14 at 0.80 miss 9; fewer above.

Candidates are confirmed on the full sets.  Texts with equal sets are one class.
A table's bucket is never turned into all its pairs: its members are compared with
its smallest member, first one such pair for each class, then those pairs that
still join two components.  What several components still share after that is
compared bucket by bucket of A, large ones in blocks inside tasks, which give new
links only.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import WordHashes, arrow_schema, give_back, map_batches, mixed, saved, tidy, window_hashes

SHINGLE = 5
PERCENT = 85
GROUPS = 11  # group hashes of each collection, at PERCENT
GROUP_SIZE = 3  # minhashes of a group hash
MISSED = 1e-4  # share of the pairs at the threshold that may share no table
UNSHARED = 1e-5  # and that may share fewer group hashes than `least_shared`
SMALL = 64  # members of a bucket that gives its pairs
BLOCK = 512  # members of a larger bucket that are compared with as many at a time

_SKETCH = "doc_id long, k1 long, n_shingles long, node long, set2 long, a array<long>, b array<long>"


def table_groups(percent: int, group_size: int = GROUP_SIZE) -> int:
    """Fewest group hashes of each collection with which fewer than MISSED of the
    pairs at the threshold share no table."""
    differ, groups = 1 - (percent / 100) ** group_size, 1
    while 1 - (1 - differ**groups) ** 2 >= MISSED:
        groups += 1
    return groups


def least_shared(percent: int, groups: int, group_size: int = GROUP_SIZE) -> int:
    """Group hashes of both collections that a linked pair shares, at least, but for
    UNSHARED of the pairs at the threshold.  At 0.85 a pair has 13.5 of 22 on average
    and fewer than 4 in 6 of a million cases; at 0.80 14.3 of 28, and 8 of a million.
    One in each collection at least: it shares a table."""
    n, agree, least = 2 * groups, (percent / 100) ** group_size, 0
    fewer = (1 - agree) ** n
    while fewer < UNSHARED:
        least += 1
        fewer += comb(n, least) * agree**least * (1 - agree) ** (n - least)
    return max(2, least)


def shingle_sets(texts: list[str | None], hashes: WordHashes, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    words = [t.encode().lower().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    row = [hashes.of(w) for w in words]
    runs = window_hashes(np.concatenate(row), size) if counts.sum() >= size else None
    starts = np.cumsum(counts) - counts
    out = []
    for w, n, s in zip(words, counts.tolist(), starts.tolist()):
        if n >= size:
            out.append(np.unique(runs[s : s + n - size + 1]))
        elif n:
            import xxhash

            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(w), seed=n)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (
        rng.integers(0, 1 << 63, n, dtype=np.uint64),
        rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1),
    )


def group_hashes(sets: list[np.ndarray], groups: int, size: int) -> np.ndarray:
    """The group hashes of both collections (columns) of non-empty sets (rows)."""
    all_, n = np.concatenate(sets), 2 * groups * size
    lengths = np.array([len(s) for s in sets])
    starts = np.cumsum(lengths) - lengths
    masks, factors = _constants(n)
    out = np.zeros((len(sets), 2 * groups), dtype=np.uint64)
    for h in range(n):
        least = np.minimum.reduceat((all_ ^ masks[h]) * factors[h], starts)
        out[:, h // size] = mixed(out[:, h // size] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out.view(np.int64)


def sketch(docs: DataFrame, shingle: int, groups: int, group_size: int) -> DataFrame:
    """One row per row of `docs`: set size, its class (`node`, `set2`: two hashes
    of the whole set), and the group hashes; no hashes for empty sets."""

    def make():
        hashes = WordHashes()

        def turn(batch):
            sets = shingle_sets(batch.column("text").to_pylist(), hashes, shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            a: list = [None] * len(sets)
            b: list = [None] * len(sets)
            node, set2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if full:
                groups_ = group_hashes([sets[i] for i in full], groups, group_size)
                for i, row in zip(full, groups_):
                    a[i], b[i] = row[:groups], row[groups:]
                    node[i] = mixed(sets[i]).sum(dtype=np.uint64)
                    set2[i] = mixed(sets[i] * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)
            return {
                "doc_id": batch.column("doc_id"),
                "k1": batch.column("k1"),
                "n_shingles": [len(s) for s in sets],
                "node": mixed(node + set2).view(np.int64),
                "set2": set2.view(np.int64),
                "a": pa.array(a, pa.list_(pa.int64())),
                "b": pa.array(b, pa.list_(pa.int64())),
            }

        return turn

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), "text")
    return map_batches(keyed, make, _SKETCH)


def _colliding(classes: DataFrame) -> DataFrame:
    """Classes that share a group hash of each collection with another class: only
    they can share a table."""
    sides = [
        classes.select("node", F.lit(s).alias("side"), F.posexplode(s).alias("i", "v")) for s in "ab"
    ]
    keyed = sides[0].union(sides[1]).select("node", "side", F.xxhash64("side", "i", "v").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    both = (
        keyed.join(shared, "key")
        .groupBy("node")
        .agg(F.max(F.col("side") == "a").alias("in_a"), F.max(F.col("side") == "b").alias("in_b"))
        .where("in_a AND in_b")
    )
    return classes.join(both.select("node"), "node", "left_semi")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, node, least) for the tables of each class that another class shares."""
    keyed = classes.select("node", "b", F.posexplode("a").alias("i", "va")).select(
        "node", "i", "va", F.posexplode("b").alias("j", "vb")
    )
    rows = keyed.select(F.xxhash64("i", "j", "va", "vb").alias("key"), "node")
    stars = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    return rows.join(stars, "key")


def _shingles_of(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of each class, one row each, read from one of its rows."""

    def make():
        hashes = WordHashes()

        def turn(batch):
            sets = shingle_sets(batch.column("text").to_pylist(), hashes, shingle)
            return {"node": batch.column("node"), "shingles": [s.tobytes() for s in sets]}

        return turn

    keyed = _first_in_task(docs.select(F.xxhash64("doc_id", "text").alias("k1"), "text"))
    # a repeated row is one row of each task here, and one row of its class after this
    heads = keyed.join(classes.select("head.k1", "node"), "k1")
    one = heads.groupBy("k1", "node").agg(F.first("text").alias("text"))
    return map_batches(one.select("node", "text"), make, "node long, shingles binary")


def _first_in_task(keyed: DataFrame) -> DataFrame:
    """(k1, text) of the rows whose key is new in their task."""
    schema = arrow_schema("k1 long, text string")

    def run(batches):
        give_back()
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("k1").to_pylist()
            keep = []
            for k in keys:
                keep.append(k not in seen)
                seen.add(k)
            if all(keep):
                yield batch.select(["k1", "text"]).cast(schema)
            else:
                yield batch.select(["k1", "text"]).filter(pa.array(keep)).cast(schema)

    return keyed.mapInArrow(run, "k1 long, text string")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those whose full sets are similar enough."""
    with_u = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    with_v = with_u.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")

    def run(batches):
        give_back()
        for batch in batches:
            su, sv = batch.column("su"), batch.column("sv")
            keep = [
                linked(
                    np.frombuffer(x.as_buffer(), dtype="<u8"),
                    np.frombuffer(y.as_buffer(), dtype="<u8"),
                    percent,
                )
                for x, y in zip(su, sv)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return with_v.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, the component named by its least
    node: large-star and small-star steps until every link leads to a root."""
    links = saved(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct(),
        "links",
    )
    while not links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or (
        not links.groupBy("u").count().where("count > 1").isEmpty()
    ):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        links = saved(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(root.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "links",
        )
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    own = labels.select(F.col("node").alias(node), F.col("component").alias("_c"))
    return rows.join(own, node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")


def _cross_pairs(rows: list[dict], percent: int, shared: int, two_sides: bool):
    """For each member of a bucket of A_i, the earlier ones of other components that
    share a table and `shared` group hashes, may be similar enough, and share no bucket
    before this one."""
    a, b = np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows])
    group = np.array([r["component"] for r in rows])
    own = np.array([r["own"] for r in rows])
    size = np.array([r["n_shingles"] for r in rows])
    for k in range(1, len(rows)):
        other = group[:k] != group[k]
        if two_sides:
            other &= own[:k] != own[k]
        other &= 100 * np.minimum(size[:k], size[k]) >= percent * np.maximum(size[:k], size[k])
        same_a, same_b = a[:k] == a[k], b[:k] == b[k]
        other &= (same_a.argmax(1) == rows[0]["i"]) & same_b.any(1)
        other &= same_a.sum(1) + same_b.sum(1) >= shared
        yield k, np.flatnonzero(other).tolist()


def _leftover(
    classes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, shared: int
) -> DataFrame:
    """Links between the components that still share a table.

    All tables of one A_i are looked at together, in the bucket of that hash: m rows
    for a class instead of m*m.  A pair is looked at in the first bucket it shares.
    Buckets of up to SMALL members give their pairs, to be confirmed like others; of
    larger ones every two blocks meet in a task, which compares the sets themselves
    and gives links only."""
    rows = _labelled(classes.select("node", "n_shingles", "a", "b"), labels, "node", "component")
    rows = rows.select("*", F.posexplode("a").alias("i", "v"))
    open_ = (
        rows.groupBy("i", "v")
        .agg(
            F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("n")
        )
        .where("c1 <> c2")
        .select("i", "v", F.when(F.col("n") > SMALL, F.ceil(F.col("n") / BLOCK)).otherwise(0).alias("blocks"))
    )
    members = saved(
        rows.join(open_, ["i", "v"]).withColumn(
            "own", F.pmod(F.xxhash64("node", "i"), F.greatest("blocks", F.lit(1))).cast("int")
        ),
        "open-buckets",
    )

    def pairs(table: pa.Table) -> pa.Table:
        give_back()
        rows = table.to_pylist()
        found = [
            (rows[q]["node"], rows[k]["node"])
            for k, near in _cross_pairs(rows, percent, shared, False)
            for q in near
        ]
        return _links(found)

    def compare(table: pa.Table) -> pa.Table:
        give_back()
        rows = table.to_pylist()
        group = np.array([r["component"] for r in rows])
        sets_ = [np.frombuffer(r["shingles"], dtype="<u8") for r in rows]
        found = []
        for k, near in _cross_pairs(rows, percent, shared, rows[0]["x"] != rows[0]["y"]):
            for q in near:
                if group[q] != group[k] and linked(sets_[q], sets_[k], percent):
                    found.append((rows[q]["node"], rows[k]["node"]))
                    group[group == group[q]] = group[k]
        return _links(found)

    small = members.where("blocks = 0").groupBy("i", "v").applyInArrow(pairs, "u long, v long")
    links = _confirmed(saved(small.distinct(), "pairs"), sets, percent)
    large = members.where("blocks > 0")
    if large.isEmpty():
        return links
    large = large.withColumn("other", F.explode(F.expr("sequence(0, cast(blocks AS int) - 1)")))
    large = large.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    return links.union(
        large.join(sets, "node").groupBy("i", "v", "x", "y").applyInArrow(compare, "u long, v long")
    )


def _links(found: list[tuple[int, int]]) -> pa.Table:
    u, v = zip(*found) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    groups: int | None = None,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """Components of near-duplicate `docs` (doc_id, text): (doc_id, k1, n_shingles,
    component_id, kept, chosen), one row per row; `k1` is xxhash64(doc_id, text).

    A document's set holds its distinct runs of `shingle` words (A-Z lower-cased);
    a text with fewer words is one run; a null text or one without words has an
    empty set and is linked with nothing.  Two documents are linked if
    100 * intersection >= percent * union.  `component_id` is the smallest doc_id of
    the component, `kept` says that it is the row's own; null ids count only where a
    component has no other, and a row without one is kept if its component has none.
    Rows of one id are looked at each for itself, so several of a component may be
    kept; `chosen` is one content of the component only, by the smallest (doc_id, k1)
    with null ids last.  Other columns are not read.
    `groups` group hashes of each collection, as many as `percent` needs by default.
    """
    spark = docs.sparkSession
    groups = groups or table_groups(percent, group_size)
    shared = least_shared(percent, groups, group_size)
    rows = saved(sketch(docs, shingle, groups, group_size), "sketch")
    classes = saved(
        rows.where("n_shingles > 0")
        .groupBy("node", "set2")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1")).alias("head"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("a").alias("a"),
            F.first("b").alias("b"),
        ),
        "classes",
    )
    close = saved(_colliding(classes), "colliding")
    buckets = saved(_buckets(close), "buckets")
    sets = saved(_shingles_of(docs, close, shingle), "shingles")
    tidy(spark)

    stars = buckets.where("node <> least").select(F.col("node").alias("v"), F.col("least").alias("u"))
    first = stars.groupBy("v").agg(F.min("u").alias("u"))
    labels = components(_confirmed(first.select("u", "v"), sets, percent))
    tidy(spark)
    rest = _labelled(_labelled(stars.distinct(), labels, "u", "cu"), labels, "v", "cv").where("cu <> cv")
    rest = rest.join(first, ["u", "v"], "left_anti")
    known = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    labels = components(known.union(_confirmed(rest.select("u", "v"), sets, percent)))
    tidy(spark)
    known = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    labels = components(known.union(_leftover(close, labels, sets, percent, shared)))
    tidy(spark)

    named = _labelled(classes.select("node", "head"), labels, "node", "component")
    roots = named.groupBy("component").agg(F.min("head").alias("head"))
    of_node = named.join(roots.withColumnRenamed("head", "root"), "component").select("node", "root")
    # only components of several rows differ from the row's own id
    full = F.col("n_shingles") > 0
    return (
        rows.select("doc_id", "k1", "n_shingles", "node")
        .join(of_node.groupBy("node").agg(F.min("root").alias("root")), "node", "left")
        .select(
            "doc_id",
            "k1",
            "n_shingles",
            F.when(full, F.col("root.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(full, F.col("root.k1")).otherwise(F.col("k1")).alias("root_k1"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .withColumn("chosen", F.col("kept") & (F.col("k1") == F.col("root_k1")))
        .drop("root_k1")
    )
