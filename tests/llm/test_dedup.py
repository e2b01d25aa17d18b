"""Near-duplicates and repeated passages against plain versions."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assetry.llm import minhash, substring
from assetry.llm.common import WordHashes, arrow_schema
from tests.llm.plain import frame, near_components, odd_texts, shingles, windows


def sorted_rows(rows):
    return sorted(map(str, rows))


def test_repeated_passages(spark):
    rows = odd_texts()
    plain = windows(rows)
    got = substring.dedup(frame(spark, rows)).collect()
    want = [
        (rows[i][0], len(w), len(w) - len(k), hashlib.sha256(b" ".join(k)).hexdigest())
        for i, (w, k) in plain.items()
    ]
    own = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got]
    assert sorted_rows(own) == sorted_rows(want)
    assert sum(r.n_removed for r in got) > 500
    assert substring.dedup(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("window", [2, 3, 8, 35])
def test_random_repeats(spark, monkeypatch, window):
    """Few words, so that runs repeat within and across documents, in many batches."""
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 120)))) for i in range(60)]
    shared = " ".join(rng.choices("fghij", k=50))
    rows += [(60 + i, f"{rng.random()} " * (i % 20) + shared) for i in range(40)]
    plain = windows(rows, window)
    got = substring.dedup(frame(spark, rows).repartition(7), window).collect()
    assert {r.doc_id: r.text.encode() for r in got} == {
        rows[i][0]: b" ".join(k) for i, (_, k) in plain.items()
    }


def test_a_batch_holds_hashes_not_words(monkeypatch):
    """Words of a batch of documents, of 50 bytes and more each, are not held together."""
    monkeypatch.setattr(substring, "BATCH_WORDS", 1 << 16)
    monkeypatch.setattr(WordHashes, "LIMIT", 1000)
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(200)]
    columns = [{"k1": [i] * 20, "k2": [i] * 20, "text": texts[i : i + 20]} for i in range(0, 200, 20)]
    tracemalloc.start()
    try:
        for _ in substring._send_probes(8, 35)(map(pa.RecordBatch.from_pydict, columns)):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200 * substring.BATCH_WORDS


def test_windows_of_a_batch_go_out_once():
    """A passage of many documents costs one entry for each of its windows and batch."""
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([f"a{i}", *passage, f"z{i}"]) for i in range(50)]
    codes = substring._codes(substring._Runs(WordHashes(), [t.encode().split() for t in texts[:1]], 35).hash, 1)
    anchors = np.unique(codes[1].astype("<u8")).tobytes()
    table = pa.RecordBatch.from_pylist(
        [{"k1": i, "k2": i, "anchors": anchors, "text": t} for i, t in enumerate(texts)]
    )
    rows = [r for b in substring._send_windows(1, 35)([table]) for r in b.to_pylist()]
    sent = sum(len(r["a"]) // 8 for r in rows if r["kind"] == substring._PROBES)
    # 26 windows of the passage once, those over its ends for each text
    assert sent <= 26 + 2 * len(texts)
    answers = substring._find_repeats(pa.Table.from_pylist(rows, pa.schema(arrow_schema(substring._SENT))))
    ranges = substring._ranges_of_docs(35)(answers).to_pylist()
    assert len(ranges) == 50
    assert all(np.frombuffer(r["ranges"], "<u4").tolist() == [1, 61] for r in ranges)


def test_ranges():
    assert substring.ranges_of(np.array([0, 1, 35, 36, 100]), 35).tolist() == [[0, 71], [100, 135]]
    assert substring.kept_words([b"a"] * 3, None) == [b"a"] * 3


def test_near_duplicates(spark):
    rows = odd_texts()
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = [
        (i, len(shingles(t)), c if shingles(t) else i, c == i if shingles(t) else True)
        for (i, t), c in zip(rows, near_components(rows))
    ]
    assert sorted_rows((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted_rows(want)
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def near_copies(groups, size, seed):
    """Groups of near copies around the threshold, chains among them."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(60, 150))]
        for _ in range(size):
            if rng.random() < 0.3:
                base = edited(rng, base, 1).split()
            rows.append((len(rows), edited(rng, base, rng.randint(0, 3))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [64, 3])
def test_groups_of_near_copies(spark, monkeypatch, small):
    """With pairs of small buckets, and with blocks for all."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = near_copies(12, 14, small)
    got = minhash.near_duplicates(frame(spark, rows, extra=False)).collect()
    assert {r.doc_id: r.component_id for r in got} == {
        i: c for (i, _), c in zip(rows, near_components(rows))
    }
    assert max(Counter(r.component_id for r in got).values()) > 3


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 80), rng.randrange(50, 80)) for _ in range(40)]
    got = {
        r.node: r.component
        for r in minhash.components(spark.createDataFrame(links, "u long, v long")).collect()
    }
    root = {n: n for link in links for n in link}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    for n, r in root.items():
        assert got.get(n, n) == r


def test_table_count():
    """At the threshold fewer than one pair in ten thousand shares no table."""
    agree = 1 - (1 - 0.85**minhash.GROUP_SIZE) ** minhash.GROUPS
    assert 1 - agree**2 < 1e-4


def test_sizes_follow_the_threshold():
    assert minhash.table_groups(85) == minhash.GROUPS and minhash.table_groups(80) == 14
    assert minhash.least_shared(85, 11) == 4 and minhash.least_shared(80, 14) == 4
    assert minhash.least_shared(80, 3) == 2


def test_repeated_rows_are_one_set(spark):
    """Two near copies, each repeated 1,000 times: one row of shingles each."""
    words = [f"w{i}" for i in range(200)]
    near = ["x", *words[1:]]
    rows = [(1, " ".join(words))] * 1000 + [(2, " ".join(near))] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    classes = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    classes = classes.selectExpr("struct(xxhash64(doc_id, text) AS k1) AS head", "doc_id AS node")
    sets = minhash._shingles_of(df, classes, 5)
    assert sorted(r.node for r in sets.collect()) == [1, 2]
    assert minhash._first_in_task(df.selectExpr("xxhash64(doc_id, text) AS k1", "text")).count() <= 14
    pairs = spark.createDataFrame([(1, 2)], "u long, v long")
    assert minhash._confirmed(pairs, sets, 80).count() == 1
    got = minhash.near_duplicates(df, percent=85).select("doc_id", "component_id").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1)]


def test_passages_keep_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, k1 int, k2 int, ranges int")
    got = substring.with_repeats(df)
    assert got.columns == ["doc_id", "text", "k1", "k2", "ranges"]
    assert tuple(got.first()) == (1, "a b", 5, 6, None)


def test_one_row_repeated_in_a_third_of_the_table(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text)] * 2000 + [(10 + i, f"only {i} " + " ".join(f"v{i}x{k}" for k in range(40))) for i in range(4000)]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    assert {(r.n_words, r.n_removed) for r in got if r.doc_id == 1} == {(80, 80)}
    assert {r.n_removed for r in got if r.doc_id != 1} == {0} and len(got) == 6000
