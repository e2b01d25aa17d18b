"""Toxicity, rules and quality: plain versions, held-out accuracy, odd rows."""

import os
import zlib
from collections import Counter
from itertools import product

import pytest

from assetry.llm import quality, rules, toxicity
from assetry.llm.fitting import held_out, training_sample
from tests.llm.plain import frame, odd_texts

SF_DIR = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
LABELS = "doc_id long, quality int, toxic int"


def plain_measures(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, repeated = Counter(runs), set()
    for i, r in enumerate(runs):
        if seen[r] > 1:
            repeated.update(range(i, i + 8))
    return (
        len(words), len(b"".join(words).decode()), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(repeated),
    )


def test_ledger(spark):
    rows = odd_texts() + [(90, "# | <b> & % $ * >"), (91, "a b c d e f g h " * 9), (92, "x " * 7)]
    got = rules.apply_policy(rules.ledger(frame(spark, rows))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(str((r.doc_id, *(r[n] for n in names))) for r in got) == sorted(
        str((i, *plain_measures(t))) for i, t in rows
    )
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.ledger(frame(spark, rows).limit(0)).count() == 0


def test_ablation(spark):
    df = frame(spark, odd_texts(), extra=False)
    ledger = rules.apply_policy(rules.ledger(df))
    rows = ledger.collect()
    mask = rules.mask(rules.POLICIES["2"])
    for r in rules.ablation(ledger).collect():
        bit = rules.mask((r.rule,))
        assert r.n_failed == sum(x.failed & bit > 0 for x in rows)
        assert r.n_alone == sum(x.failed & mask == bit for x in rows)
        assert r.n_rejected == sum(not x.kept for x in rows)


SYMBOLS = {
    "i": toxicity.INSULT, "t": toxicity.THREAT, "y": toxicity.TARGET, "n": toxicity.NEGATION,
    "r": toxicity.REPORT, "o": toxicity.OTHER, "d": toxicity.DOUBTFUL,
}


def kinds_of(clause):
    following, output = toxicity.grammar().table(range(8))
    state, out = 0, []
    for c in clause:
        kind = output[state, SYMBOLS[c]]
        state = following[state, SYMBOLS[c]]
        if kind >= 0:
            out.append(int(kind))
    return out


def test_grammar():
    assert kinds_of("oio") == [0] and kinds_of("noi") == [1] and kinds_of("roi") == [2]
    assert kinds_of("yoi") == [4] and kinds_of("noooi") == [0] and kinds_of("ryni") == [7]
    assert kinds_of("oto") == [] and kinds_of("ty") == [12] and kinds_of("tooooy") == []
    assert kinds_of("nty") == [13] and kinds_of("yt") == [12] and kinds_of("d") == [16]


def test_grammar_by_hand():
    """Every short clause against the scopes counted in words."""
    for clause in product("itynro", repeat=5):
        want, held = [], None
        for k, c in enumerate(clause):
            def near(symbol, reach):
                return any(s == symbol and k - q <= reach for q, s in enumerate(clause[:k]))

            marks = near("n", 3) + 2 * near("r", 12) + 4 * near("y", 5)
            if c == "i":
                want.append(marks)
            elif c == "t" and marks & 4:
                want.append(marks + 8)
                held = None
                continue
            elif c == "t":
                held = (marks, k)
                continue
            elif c == "y" and held and k - held[1] <= 4:
                want.append(held[0] + 4 + 8)
                held = None
                continue
        assert kinds_of(clause) == want, clause


def test_toxicity_odd_rows(spark):
    rows = odd_texts()
    got = toxicity.classify(frame(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (2, 0, 0)], LABELS)
    assert toxicity.classify(frame(spark, rows).limit(0), labels).count() == 0


def test_training_sample_is_bounded(spark):
    """A labelled id of many rows is one row of the sample."""
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"text {i}") for i in ids] + [(ids[0], f"other {k}") for k in range(200)] + [(ids[1], None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in ids], LABELS)
    for limit in (10, 1000):
        sample = training_sample(frame(spark, rows), labels, "quality", limit).collect()
        assert len(sample) == len({r.doc_id for r in sample}) == min(limit, len(ids))
        assert all((r.doc_id, r.text) in rows and r.y == 1 for r in sample)


def test_labels_are_learned_outside_the_fold_only(spark):
    """Turning the held-out labels round changes no score."""
    rows = [(i, f"the {'vile brute' if i % 4 == 0 else 'kind friend'} went home {i}") for i in range(400)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], LABELS)
    turned = labels.withColumn("toxic", (held_out().cast("int") + labels.toxic) % 2)
    one = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity.classify(docs, turned).collect()}
    assert one == two
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in one.items())


def test_quality_odd_rows(spark):
    rows = [(i, t, "s", "en", 1) for i, t in odd_texts()] + [(95, "a b", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    docs = docs.selectExpr("*", "1 AS _site", "2 AS mean", "3 AS path_mean")
    none = spark.createDataFrame([], LABELS)
    got = quality.score(docs, none)
    assert got.count() == len(rows) and got.where("NOT quality_kept").isEmpty()
    assert got.where("path_mean IS NULL").isEmpty()
    assert quality.score(docs.limit(0), none).count() == 0


def test_shrinking(spark):
    """Sparse paths lie nearer to their host than full ones, hosts nearer to all."""
    rows = [("big", "p", 0.1)] * 300 + [("big", "q", 0.1)] + [("small", "p", 0.1)] + [("rest", "p", 0.9)] * 300
    table = {
        (r.host, r.path): r
        for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, quality_evidence double")).collect()
    }
    big, one, small = table["big", "p"], table["big", "q"], table["small", "p"]
    assert abs(big.path_mean - 0.1) < abs(small.path_mean - 0.1)
    assert big.host_mean == one.host_mean < small.host_mean < big.mean
    assert 0.1 < one.path_mean <= one.host_mean
    assert quality.strength(0.5, 1, 10, 100, 0) == quality.MAX_STRENGTH


@needs_tables
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = quality.score(docs, labels).join(labels, "doc_id").where(held_out())
    right = found.where("quality_kept = (quality = 1)").count()
    assert right >= 0.95 * found.count()
    found = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out")
    assert found.where("predicted = toxic").count() >= 0.9 * found.count()
    assert found.where("predicted = 1 AND toxic = 0").count() <= 0.02 * found.count()


def plain_posteriors(rows):
    """Means of hosts and paths from (host, path, evidence), by loops."""
    n = len(rows)
    mean = min(max(sum(e for *_, e in rows) / n, 1e-6), 1 - 1e-6)
    hosts, paths = {}, {}
    for h, p, e in rows:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)

    def k_of(groups, centre):
        between = sum(len(v) * (sum(v) / len(v) - centre(g)) ** 2 for g, v in groups.items())
        squares = sum(len(v) ** 2 for v in groups.values())
        return quality.strength(mean, len(groups), float(n), float(squares), between)

    k = k_of(hosts, lambda g: mean)
    host_mean = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in hosts.items()}
    k = k_of(paths, lambda g: sum(hosts[g[0]]) / len(hosts[g[0]]))
    return {
        g: (host_mean[g[0]], (sum(v) + k * host_mean[g[0]]) / (len(v) + k)) for g, v in paths.items()
    }


def test_posteriors_equal_plain_ones(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("abcd"), rng.choice("xyz"), rng.random() ** (1 + "abcd".find(h))) for h in "abcd" for _ in range(60)]
    rows += [("e", "x", 0.99), (None, "x", 0.2), ("a", None, 0.4)]
    df = spark.createDataFrame(rows, "host string, path string, quality_evidence double")
    got = {(r.host, r.path): (r.host_mean, r.path_mean) for r in quality.posteriors(df.where("host IS NOT NULL")).collect()}
    want = plain_posteriors([r for r in rows if r[0] is not None])
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for g in got for a, b in zip(got[g], want[g]))


def test_few_distinct_words_at_any_length(spark):
    rows = [(n, " ".join(f"w{i * 7919 % k}" for i in range(n))) for n, k in ((400, 20), (400, 390), (5000, 40), (5000, 900))]
    failed = {}
    bit = rules.mask(("few_distinct_words",))
    for r in rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        failed.setdefault(r.doc_id, []).append(bool(r.failed & bit))
    assert {n: sorted(v) for n, v in failed.items()} == {400: [False, True], 5000: [False, True]}
