"""Merkle manifest: all trees and proofs again by plain loops."""

import hashlib
import zlib
from collections import defaultdict
from itertools import chain

import pytest
from pyspark.sql import functions as F

from assetry.llm import merkle
from tests.llm.plain import CLASHING, odd_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha("".join(map(one, (doc_id, source, lang, n_chars, text))))


def plain_levels(level):
    out = [level]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        out.append(level)
    return out


def plain_path(levels, i):
    for level in levels[:-1]:
        first = i - i % 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def plain_proofs(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[s] = plain_levels([plain_leaf(*r) for r in by_source[s]])
    forest = plain_levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, r in enumerate(by_source[s]):
            folded = plain_leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                folded = plain_leaf(r[0], low, *r[2:])
            proof = ""
            for left, right in chain(plain_path(trees[s], i), plain_path(forest, k)):
                proof += "".join(left + right)
                folded = sha("".join([*left, folded, *right]))
            root = forest[-1][0]
            yield (r[0], s, plain_leaf(*r), trees[s][-1][0], root, sha(proof), folded, folded == root)


def odd_rows():
    texts = odd_texts() + [(i, f"Text {i} of MANY") for i in range(100, 700)]
    rows = [
        (i, t, None if k % 7 == 0 else "en", "hot" if k % 3 else (None, "", "ß", "a b", "z")[k % 5],
         None if k % 11 == 0 else len(t or ""))
        for k, (i, t) in enumerate(texts)
    ]
    return rows + [(5000, "One alone", "en", "lone", 3)] + [(5000 + k % 3, "Same ROW", "en", "again", 9) for k in range(300)]


def with_clashes(df):
    names = [n.strip() for n in CLASHING.split(",")] + ["tampered", "leaf", "rank", "n", "pos", "place", "block", "idx"]
    return df.select("*", *[F.lit("x").alias(n) for n in dict.fromkeys(names) if n not in df.columns])


@pytest.fixture(scope="module")
def made(spark):
    rows = odd_rows()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(5))
    return rows, merkle.build(df)


def test_equals_plain_trees(made):
    rows, manifest = made
    got = [tuple(r) for r in merkle.prove(manifest, block=128).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_proofs(rows)))
    assert {r[-1] for r in got} == {True, False}


def test_some_leaves_have_the_same_proofs(made):
    rows, manifest = made
    got = merkle.prove(manifest, (F.col("place") % 37 == 0) | F.col("doc_id").isNull()).collect()
    every = set(map(repr, plain_proofs(rows)))
    assert 20 < len(got) < 60 and {repr(tuple(r)) for r in got} <= every


def test_one_row_and_none(spark):
    for row in [(1, "A", "en", "s", 1), (None, None, None, None, None)]:
        got = merkle.prove(merkle.build(spark.createDataFrame([row], SCHEMA))).collect()
        assert [tuple(r) for r in got] == list(plain_proofs([row]))
        assert got[0].proof_sha256 == sha("") and got[0].root == got[0].leaf
    assert merkle.prove(merkle.build(spark.createDataFrame([], SCHEMA))).collect() == []


def test_missing_is_the_least_set():
    n = 5000
    for known in ([0], [n - 1], range(100, 300), range(n), [1, 17, 4095, 4096, 4999]):
        asked = {(level, i) for level, ids in merkle.missing(known, n) for i in ids}
        derived, wanted, row, size, level = set(), set(), set(known), n, 0
        while size > 1:
            derived |= {(level, i) for i in row}
            wanted |= {(level, j) for i in row for j in range(i - i % 16, min(i - i % 16 + 16, size))}
            row, size, level = {i // 16 for i in row}, -(-size // 16), level + 1
        assert asked == wanted - derived


def test_wanted_nodes_are_few(made):
    _, manifest = made
    plan = merkle.prove(manifest)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
