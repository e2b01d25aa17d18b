"""Personal data: the base against the plain regexes, and the bootstrap against loops."""

import hashlib
import math
import os
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetry.llm import pii
from assetry.llm.queries import op11_pii
from tests.llm.plain import frame, odd_texts

SF_DIR = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
FORMS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_base(text):
    out = []
    for kind, form in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(d) for d in digits[::-1][::2]] + [sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2]]
            good = (
                True,
                kind == 1 and all(int(x) <= 255 for x in m[0].split(".")),
                13 <= len(digits) <= 19 and sum(odd) % 10 == 0,
                9 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((kind, *m.span()))
    return out


ODD = [
    "a@b.c@d.e f@g", "@a.b x@.c y@-.-", "..%+-@a-b.c.d.", "a@b..c d@e.f.", "a@b@c.d", "x" * 300 + "@a.b",
    "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 0255.0.0.1 1.2.3", "1..2.3.4.5", "9.9.9.9" * 3,
    "4111 1111 1111 1111", "4111-1111-1111-1111 5", "41111111 11111111 1", "4111  1111 1111 1111", "0" * 16, "0" * 20,
    "+1 (555) 123-4567", "+15551234567", "+1 555", "+1" + " " * 50 + "23456789", "+1(2)3+44 5566778899", "++12 345678901",
    "١٢٣.١.١.١ +١٢٣٤٥٦٧٨٩", "é+1 555 123 4567é 日本 a@b.c",
]


@pytest.mark.parametrize("text", ODD)
def test_odd_forms(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1205@.+-( )%é9", max_size=60))
def test_any_form(text):
    assert pii.base_spans(text) == plain_base(text)
    base = pii.base_spans(text)
    taken = {i for _, s, e in base for i in range(s, e)}
    for o in pii.occurrences(text, base):
        assert o["kind"] >= 0 or not taken.intersection(range(o["start"], o["end"]))


def test_very_long_runs_take_linear_time():
    for text in ("1" * 500_000, "+1" + " " * 500_000, "a" * 500_000 + "@", "1 " * 300_000, "@" * 300_000, "1." * 200_000):
        pii.base_spans(text)
        list(pii.occurrences(text, []))


def corpus(seed=2):
    """Phones stand after `ring me on`, addresses after `write to`, other numbers elsewhere; some
    phones and addresses have no base form."""
    rng = random.Random(seed)
    rows, hidden = [], []
    for i in range(400):
        number = f"{rng.randint(200, 999)} {rng.randint(200, 999)} {rng.randint(1000, 9999)}"
        words = " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(3))
        what = i % 5
        if what == 0:
            text = f"{words} ring me on +1 {number} {words}"
        elif what == 1:
            text = f"{words} write to user{i}@mail{i % 7}.org {words}"
        elif what == 2:
            text = f"{words} invoice {number} {words}"
        elif what == 3:
            text = f"{words} part no. {rng.randint(10**6, 10**9)}x {words}"
        elif i % 2:
            text = f"{words} ring me on {number}, {words}"
            hidden.append((i, "phone", number))
        else:
            text = f"{words} write to user{i}@intranet {words}"
            hidden.append((i, "email", f"user{i}@intranet"))
        rows.append((i, text))
    return rows, hidden


def spans_of(found, rows):
    texts = dict(rows)
    return {
        (r.doc_id, pii.KINDS[s.kind], texts[r.doc_id][s.start : s.end])
        for r in found.collect()
        for s in set(map(tuple, r.spans)) - set(map(tuple, r.base)) and [x for x in r.spans if x not in r.base]
    }


def test_contexts_give_unseen_identifiers_away(spark):
    rows, hidden = corpus()
    # copies of one document say no more than one, and teach nothing
    rows += [(1000 + i, "buy 555 123 4567 now") for i in range(300)] + [(2000, "buy +1 555 123 4567 now")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    added = spans_of(found, rows)
    assert set(hidden) <= added
    assert not [x for x in added if "invoice" in dict(rows)[x[0]] or x[0] >= 1000]


def plain_bootstrap(seen, rounds):
    """The same scores by loops."""
    edges, looks, seeds = defaultdict(set), defaultdict(int), defaultdict(set)
    for o in seen:
        looks[o["value"]] |= o["looks"]
        if o["kind"] >= 0:
            seeds[o["value"]].add(o["kind"])
        for p in o["patterns"]:
            edges[p].add((o["value"]))
    at_edge = defaultdict(int)
    for o in seen:
        for p in o["patterns"]:
            at_edge[p, o["value"]] |= o["looks"]
    needed = {}
    for k in range(4):
        share = sum(k in seeds[v] for v in looks) / len(looks)
        if 0 < share < 1:
            needed[k] = max(pii.LEAST_SEEDS, math.log(len(edges) / pii.CHANCE) / -math.log(share))
    scores = {}
    for _ in range(rounds):
        accepted = {}
        for p, values in edges.items():
            for k, least in needed.items():
                n = sum(k in seeds[v] for v in values)
                unknown = [v for v in values if at_edge[p, v] >> k & 1 and not seeds[v]]
                more = sum(scores.get((v, k), 0) for v in unknown)
                rest = len(values) - len(unknown) + pii.UNKNOWN * (len(unknown) - more)
                worth = (n + more) / (rest + more + 1)
                if n >= least and worth >= pii.CONFIDENCE:
                    accepted[p, k] = worth
        left = defaultdict(lambda: 1.0)
        for (p, k), worth in accepted.items():
            for v in edges[p]:
                if not seeds[v] and at_edge[p, v] >> k & 1:
                    left[v, k] *= 1 - min(worth, 0.999)
        scores = {x: 1 - y for x, y in left.items()}
    return accepted, {x: s for x, s in scores.items() if s >= pii.CONFIDENCE}


@pytest.mark.parametrize("rounds", [1, 3])
def test_scores_equal_plain_ones(spark, rounds):
    rows, _ = corpus(7)
    table = pii.scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    patterns, values = pii.bootstrap(table.selectExpr("inline(found)"), rounds)
    seen = [o for _, t in rows for o in pii.occurrences(t, pii.base_spans(t))]
    want_patterns, want_values = plain_bootstrap(seen, rounds)
    got = {(r.pattern, r.kind): r.confidence for r in patterns.collect()}
    assert got.keys() == want_patterns.keys() and len(got) > 2
    assert all(abs(got[x] - want_patterns[x]) < 1e-9 for x in got)
    got = {(r.value, r.kind): r.score for r in values.collect()}
    assert got.keys() == want_values.keys() and all(abs(got[x] - want_values[x]) < 1e-9 for x in got)


def plain_digest(text):
    base = plain_base(text)
    spans = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
    return (*[sum(b[0] == k for b in base) for k in range(4)], hashlib.sha256(spans.encode()).hexdigest(), spans)


def test_odd_rows(spark):
    rows = odd_texts() + [(100 + i, t) for i, t in enumerate(ODD)] + [(100, ODD[0])] * 3
    df = frame(spark, rows).selectExpr("*", "1 AS row", "2 AS base", "3 AS found", "4 AS spans")
    got = pii.digests(pii.find(df)).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr((i, *plain_digest(t)[:5])) for i, t in rows)
    assert all(set(plain_digest(t)[5].split(",")) <= set(r.spans.split(",")) for r in got for i, t in rows[:1] if i == r.doc_id)
    assert pii.find(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = op11_pii(spark, SF_DIR).collect()
    want = {i: plain_digest(t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:6] == want[r.doc_id][:5]
        assert set(want[r.doc_id][5].split(",")) - {""} <= set(r.spans.split(","))
    # the rest of these texts are invented words: nothing else is personal in them
    assert sum(r.n_added for r in got) == 0
