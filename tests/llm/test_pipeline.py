"""The pipeline: stages against plain versions, the registration, a small run."""

import os
import random

import pytest

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from tests.llm.plain import near_components, odd_texts, shingles, windows

SF_DIR = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.001")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in odd_texts()]
    return spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "1 AS k1", "2 AS ranges", "3 AS cut").repartition(3)


def test_registered():
    names = {n.split("_")[0] for n in contract.queries()}
    assert names >= {f"op{n}" for n in range(1, 11)} | {"pipeline"}
    assert contract.queries()["pipeline"] is pipeline.run and len(pipeline.STAGES) == 5


@pytest.fixture
def sf_dir(spark, docs, tmp_path):
    """Tables with the odd documents, and labels of a few."""
    path = f"file://{tmp_path}"
    docs.select(*pipeline.COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_columns_and_empty_tables(spark, docs, sf_dir):
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "packing" or out.columns == list(pipeline.COLUMNS), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_one_of_each(spark, docs, sf_dir):
    rows = odd_texts()
    want = {(i, t) for (i, t), c in zip(rows, near_components(rows)) if not (t or "").split() or c == i}
    got = [(r.doc_id, r.text) for r in pipeline.one_of_each(spark, docs, sf_dir).collect()]
    assert set(got) == want and len(got) == len(want)


def test_near_duplicates_from_four_fifths_on(spark):
    """Pairs of a similarity between 0.80 and 0.85 are one document, those below two."""
    rng, rows, near = random.Random(11), [], 0
    for k in range(60):
        words = [f"p{k}w{rng.randrange(10**6)}" for _ in range(104)]
        other = list(words)
        for at in range(20, 20 + 20 * (2 + k % 2), 20):  # 90 of 110 shingles, or 85 of 115
            other[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = (shingles(t) for _, t in rows[-2:])
        near += 0.80 <= len(a & b) / len(a | b) < 0.85
        assert len(a & b) / len(a | b) < 0.85
    assert near == 30
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS)
    got = sorted(r.doc_id for r in pipeline.one_of_each(spark, docs, "").collect())
    assert got == [i for (i, _), c in zip(rows, near_components(rows, 80)) if c == i]
    assert len(got) == 90


def test_one_of_null_and_repeated_ids(spark):
    """Near copies under one id, or under none, are one document; other texts of that
    id stay."""
    base = [f"w{k}" for k in range(120)]
    copies = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (0, 60, 119)]
    nulls = [t.replace("w", "n") for t in copies]
    rows = [(1, t) for t in copies] + [(2, copies[0])] + [(None, t) for t in nulls]
    rows += [(1, "quite another text of six words"), (None, "and one more without an id"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCUMENTS).repartition(3)
    got = [(r.doc_id, r.text) for r in pipeline.one_of_each(spark, docs, "").collect()]
    assert sum(t in copies for _, t in got) == 1 and sum(t in nulls for _, t in got) == 1
    assert all(i == 1 for i, t in got if t in copies)
    assert set(rows[-4:]) <= set(got) and len(got) == 6


def test_no_repeats(spark, docs, sf_dir):
    rows = odd_texts()
    want = []
    for i, (words, kept) in windows(rows).items():
        doc_id, text = rows[i]
        if len(kept) == len(words):
            want.append((doc_id, text, None if text is None else len(text)))
        elif kept:
            cut = b" ".join(kept).decode()
            want.append((doc_id, cut, len(cut)))
    got = [(r.doc_id, r.text, r.n_chars) for r in pipeline.no_repeats(spark, docs, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_run(spark):
    """Clean documents come through, junk and toxic ones and second copies do not."""
    pieces = pipeline.run(spark, SF_DIR)
    left = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()
    junk = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in left for i in junk) <= 0.1 * len(junk)
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    first = {}
    for r in sorted(documents, key=lambda r: r.doc_id):
        assert first.setdefault(r.text, r.doc_id) == r.doc_id or r.doc_id not in left
    clean = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    assert sum(i in left for i in clean) >= 0.5 * len(clean)
