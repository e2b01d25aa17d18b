"""Conversation repair against a search over all edits, and against plain loops."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest

from assetry.llm import conversations as c
from assetry.llm.queries import op13_conversations

SF_DIR = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def fault_of(role, text, seen):
    end = text.rstrip(SPACE)
    if not end:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "" if end[-1] in ".!?" else "truncated"


def searched(rows):
    """The cheapest edits, least audit first, by Dijkstra over (cost, audit); rows are
    (role, text, fault).  Only prefixes of legal roles are followed."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and LEGAL.match(roles):
            return cost, audit, lines
        state = (i, roles[-1:], audit)
        if state in done:
            continue
        done.add(state)
        ways = [("I", 5, i, r, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            ways.append(("D", 2, i + 1, None, None))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                ways.append(("K", more, i + 1, role, (role, text)))
                ways += [("R", 1 + more, i + 1, r, (r, text)) for r in ("user", "assistant")]
        for letter, price, j, role, line in ways:
            now = roles if role is None else roles + (role[:1] or '?')  # an empty role is like an unknown one
            if re.match(r"s?(ua)*u?\Z", now) and cost + price <= 60:
                heapq.heappush(heap, (cost + price, audit + letter, j, now, lines + (line,) * (line is not None)))
    raise AssertionError


def plain_summary(rows):
    """Of one conversation's rows (turn, role, text) after damage."""
    def md5(r):
        return hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()

    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, md5(r), r[1]))
    seen, marked = set(), []
    for _, role, text in rows:
        marked.append((role, text, fault_of(role, text, seen)))
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
    cost, audit, lines = searched(marked)
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256(text.encode()).hexdigest(),
    )


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def odd_conversations(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", None, "What?", "Go on!", "x" * 5000 + ".", "Ende ", "a.b", "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "sys", "ua"]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randint(1, 6)):
            at = None if rng.random() < 0.1 else turn + (rng.random() < 0.1) * 3
            good = rng.random() < 0.6
            role = ("user", "assistant")[turn % 2] if good else rng.choice(roles)
            rows.append((conv, at, role, f"Turn {conv} {turn}." if good else rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_edits_are_the_cheapest():
    rng = random.Random(5)
    roles = ("system", "user", "assistant", "tool")
    for _ in range(300):
        rows, seen = [], set()
        for _ in range(rng.randint(0, 6)):
            role, text = rng.choice(roles), rng.choice(["a.", "b.", "c", "d.", "", "e!"])
            rows.append((None, role, text, fault_of(role, text, seen)))
            seen.add((role, text))
        got = list(c.repaired([r[:3] for r in rows]))
        cost, audit, lines = searched([r[1:] for r in rows])
        assert "".join(e[2] for e in got) == audit
        assert [(e[4], e[5]) for e in got if e[2] != "D"] == list(lines)
        told = c.Summary()
        for e in got:
            told.add(*e)
        assert told.row()[5] == cost and LEGAL.match("".join(e[4][0] for e in got if e[2] != "D"))


def test_long_runs_equal_single_rows():
    for symbol, count in product(range(16), (1, 63, 64, 65, 130, 1000)):
        v = c.AT_END
        for _ in range(count):
            v = c._step(symbol, 0, v)
        assert c.advanced(symbol, count, c.AT_END) == v
        steps = list(c.unrolled(symbol, count, 0, c.AT_END))
        assert len(steps) == count
        costs = [c.AT_END]
        for _ in range(count - 1):
            costs.append(c._step(symbol, 0, costs[-1]))
        state = 0
        for v, step in zip(reversed(costs), steps):
            assert step == c.choice(symbol, state, v)
            state = step[1]


def table(rows, ids):
    told = plain_damage(rows)
    return sorted(repr((i, *plain_summary(told[i]))) for i in ids)


def collected(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_rows(spark, parts):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    df = df.selectExpr("*", "1 AS part", "2 AS chunk", "3 AS step", "'x' AS edit", "5 AS place", "'y' AS tie", "0 AS cost")
    got = c.of_every(df, c.summaries(c.damaged(df)))
    assert collected(got) == table(rows, {r[0] for r in rows})


def test_cut_conversations_are_the_same(spark, monkeypatch):
    """Every conversation as chunks of three rows."""
    monkeypatch.setattr(c, "CHUNK_ROWS", 3)
    monkeypatch.setattr(c, "HELD_ROWS", 2)
    rows = odd_conversations(9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = c.of_every(df, c.summaries(c.damaged(df)))
    assert collected(got) == table(rows, {r[0] for r in rows})
    edits = c.repair(c.damaged(df)).collect()
    by_conv = defaultdict(list)
    for e in sorted(edits, key=lambda e: (e.part, e.chunk, e.step)):
        by_conv[e.conv_id].append(e.edit)
    audits = {r.conv_id: r.audit for r in got.collect()}
    assert {i: "".join(x) for i, x in by_conv.items()} == {i: a for i, a in audits.items() if a}


def test_a_conversation_with_a_third_of_all_rows(spark):
    """One conversation of many chunks, half of it one repeated row."""
    n = 30_000
    rows = spark.range(n).selectExpr(
        "7L AS conv_id",
        "if(id % 2 = 0, 5, id) AS turn",
        "if(id % 2 = 0 OR id % 4 = 1, 'user', 'assistant') AS role",
        "if(id % 2 = 0, 'Again.', concat('Turn ', id, '.')) AS text",
    )
    others = spark.range(2 * n).selectExpr(
        "id div 4 + 100 AS conv_id", "id % 4 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '!') AS text"
    )
    told = {r.conv_id: r for r in c.summaries(rows.unionByName(others)).collect()}
    assert len(told) == n // 2 + 1
    hot = told.pop(7)
    assert hot.duplicate == n // 2 - 1 and hot.blank == 0 and hot.truncated == 0
    assert len(hot.audit) >= n and hot.audit.count("D") >= n // 2 - 1
    assert hot.cost == 2 * hot.audit.count("D") + hot.audit.count("R") + 5 * hot.audit.count("I")
    assert {r.audit for r in told.values()} == {"KKKK"} and {r.cost for r in told.values()} == {0}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert c.of_every(df, c.summaries(c.damaged(df))).collect() == []
    assert c.repair(df).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op13_conversations(spark, SF_DIR)) == table(rows, {r[0] for r in rows})
