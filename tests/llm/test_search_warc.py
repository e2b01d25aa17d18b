"""Exact search and WARC archives against plain versions."""

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest

from assetry.llm import topk, warc

VECTORS = "vec_id long, embedding array<float>"


def plain_top(vectors, queries, k):
    def whole(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        return [int(np.floor(64.0 * float(np.float32(x)))) for x in v]

    rows = [(i, whole(v)) for i, v in vectors if i is not None and whole(v) is not None]
    out = []
    for q, v in queries:
        if q is None or whole(v) is None:
            continue
        scores = [(-sum(a * b for a, b in zip(whole(v), w)), i) for i, w in rows if i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def collected(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_top_k(spark, monkeypatch):
    """Ties, repeated vectors and queries, nulls, odd components, several tiles."""
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(150)]
    rows += [(150 + i, [0.5, 0.5, 0.0, -0.25]) for i in range(40)]  # one common vector
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan"), 0.0, 0.0, 0.0])]
    rows += [(203, [float("inf"), 0.0, 0.0, 0.0]), (204, []), (205, [1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(-5, [0.1, 0.2, 0.3, 0.4]), (20, [0.5, 0.5, 0.0, -0.25])]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS slot", "2 AS pack", "3 AS rank").repartition(3)
    queries = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=20)
    assert collected(got) == plain_top(rows, queries, 20)
    assert collected(topk.top_k(df, df.where("vec_id % 20 = 0"), k=500)) == plain_top(rows, queries, 500)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components(spark):
    """Beyond exact floats, and beyond 64 bits."""
    rows = [(20, [2.0**23, 1.0]), (1, [2.0**23, 0.5]), (2, [2.0**22, 3.0]), (3, [-(2.0**23), 0.0])]
    df = spark.createDataFrame(rows, VECTORS)
    assert collected(topk.top_k(df, df.where("vec_id = 20"), k=3)) == plain_top(rows, rows[:1], 3)
    rows[0] = (20, [2.0**100, 0.0])
    rows[3] = (3, [-(2.0**40), 0.0])
    df = spark.createDataFrame(rows, VECTORS)
    limit = 2**63 - 1
    assert collected(topk.top_k(df, df.where("vec_id = 20"), k=3)) == [
        (20, 1, 1, limit), (20, 2, 2, limit), (20, 3, 3, -limit),
    ]


def test_top_k_sends_no_block_to_the_driver(spark, monkeypatch):
    """Blocks go to slots by a shuffle, however small Spark takes them for, and slots are even."""
    monkeypatch.setattr(topk, "SHARD", 8)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(topk, "TASKS", 0)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7)
    tree = got._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :|+-")) for x in tree]
    for i, line in enumerate(tree):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(tree)) if depth[j] <= depth[i]), len(tree))
            assert not any("Generate" in x or "parquet" in x for x in tree[i + 1 : below])
    assert collected(got) == plain_top(rows, [r for r in rows if r[0] % 20 == 0], 7)
    dealt, slots = topk._in_slots(topk.saved(topk._packed(df, 8, 64.0), "shards"))
    sizes = [r["count"] for r in dealt.groupBy("slot").count().collect()]
    assert len(sizes) == slots and max(sizes) <= 3 and max(sizes) - min(sizes) <= 1


def pages():
    rng = random.Random(2)
    common = "<html>common</html>"
    rows = [(i, f"http://a.example/{i}?q=é b%20", f"<p>{rng.random()} é</p>") for i in range(30)]
    rows += [(100 + i, None, common) for i in range(20)]
    rows += [(200, "u", None), (201, "u", ""), (None, "v", common), (119, "again", common)]
    rows += [(300, "line\r\nbreak", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (301, "", "日本" * 50_000)]
    rows += [(None, None, "only null"), (None, None, "only null")]
    return rows


def plain_records(rows, least=0):
    largest = {}
    for i, _, html in rows:
        largest.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in largest[html or ""] if x is not None]
        several = len(largest[html or ""]) > 1 and len(data) >= least and ids
        original = max(ids) if several else None
        revisit = original is not None and original != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", original if revisit else None))
    return sorted(map(str, out))


def records(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(str(tuple(r[n] for n in names)) for r in df.where("last").collect())


@pytest.mark.parametrize("least", [0, 5, 10_000_000])
def test_round_trip(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.selectExpr("*", "1 AS sha1", "2 AS original", "3 AS path").repartition(3)
    archives = warc.write(df, f"file://{tmp_path}/w", least_bytes=least, archive_bytes=2000)
    assert archives.count() > 3 and archives.groupBy().sum("n_records").first()[0] == len(rows)
    assert records(warc.read(archives)) == plain_records(rows, least)
    assert records(warc.read(archives, payload=False)) == plain_records(rows, least)
    got = sorted(
        warc.read(archives).where("record_type = 'response'").collect(), key=lambda r: (r.record_id, r.chunk_no)
    )
    texts = {}
    for r in got:
        texts[r.record_id] = texts.get(r.record_id, b"") + bytes(r.data or b"")
        assert r.payload_bytes == len(texts[r.record_id]) or r.page_id is None
        assert r.payload_digest == base64.b32encode(hashlib.sha1(texts[r.record_id]).digest()).decode() or r.page_id is None
    known = {(i, u): (h or "").encode() for i, u, h in rows if i is not None}
    assert all(known[r.page_id, r.url] == texts[r.record_id] for r in got if r.page_id is not None)
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_an_archive_is_plain_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://x", "<p>hi</p>")], "page_id long, url string, html string")
    path = warc.write(df, f"file://{tmp_path}/w").first().path.removeprefix("file://")
    data = gzip.open(path).read()
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"<p>hi</p>\r\n\r\n")


def test_broken_archives():
    good = [(1, "u", "<p>one</p>")]
    head = warc._head(1, "u", "response", None, 10, warc.base32_sha1(hashlib.sha1(b"<p>one</p>")))
    whole = gzip.compress(head + b"<p>one</p>\r\n\r\n")
    assert [r[-1] for r in warc.chunks_of(io.BytesIO(whole))] == [True] * len(good)
    for bad in (head + b"<p>two</p>\r\n\r\n", head + b"<p>one</p>xx\r\n\r\n", head + b"<p>"):
        with pytest.raises(ValueError):
            list(warc.chunks_of(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(ValueError):
        list(warc.chunks_of(io.BytesIO(whole[:-20])))
