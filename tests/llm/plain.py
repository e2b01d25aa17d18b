"""Plain versions of the corpus operators, and small tables with odd rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession

# Columns whose names the operators use themselves.
CLASHING = "k1, k2, ids, start, node, host, path, mean, ranges, y, word, text_, n_words, kept"


def odd_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Documents with nulls, empty and very long texts, repeated rows, copies, near
    copies, shared passages and odd characters."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Über", "naïve", "日本", "don't", "x.", "a|b", "TEN!!"]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, passage = text(120), text(60)
    near = base.split()
    near[7] = "changed"
    far = base.split()
    far[::9] = ["other"] * len(far[::9])
    rows = [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, " ".join(far)),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "two words"),
        (9, "Two  Words"),
        (10, "one two three four five"),
        (11, text(50) + " " + passage + " " + text(40)),
        (12, passage + " " + text(70)),
        (13, text(10) + "\n" + passage.replace(" ", "\t") + "\r\n" + text(10)),
        (14, "same line\n" * 80),
        (15, text(30_000)),
        (16, text(35)),
        (17, "tabs\x0band\x0cfeeds \x1c \x85 \xa0 stay <|endoftext|> é Ａ ½ 👍🏽"),
        (18, text(34)),
        (None, base),
        (None, None),
        (19, text(200)),
        (19, text(210)),
        (20, text(90)),
        (20, None),
        (1, base),
    ]
    return rows + [(21 + i, text(rng.randint(1, 200))) for i in range(30)]


def frame(spark: SparkSession, rows, schema: str = "doc_id long, text string", extra: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    if extra:
        for i, c in enumerate(CLASHING.split(", ")):
            df = df.selectExpr("*", f"{i} AS {c}")
    return df.repartition(3)


def windows(rows, size: int = 35) -> dict[int, tuple[list[bytes], list[bytes]]]:
    """Words and kept words of each row, by its place."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = {}
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        out[i] = (w, [x for k, x in enumerate(w) if k not in gone])
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))


def near_components(rows, percent: int = 85) -> list[int | None]:
    """Component id of each row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    out = []
    for i in range(len(rows)):
        ids = [x for x in members[find(i)] if x is not None]
        out.append(min(ids) if ids else None)
    return out
