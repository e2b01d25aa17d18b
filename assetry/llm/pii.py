"""Personal data in texts: fixed forms, and identifiers that their contexts give away.

E-mail addresses, IP addresses, card and phone numbers are found by their forms (the
base).  They are the seeds of a bootstrap: the words around a seed are lexical patterns,
and all identifier-like tokens (those with a digit or an at sign) are instances.  Over
the graph of patterns and instances Spark scores both in turns: a pattern is worth the
share of its instances that are known to be of one kind (unknown ones count less than
those of another kind), an instance what the patterns it stands in say together.  Instances of high score that look like their kind, though
not in one of the base forms, are added.

Texts are read once and stay where they are; what moves are the few occurrences.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import give_back, saved, slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ROUNDS = 3
CONFIDENCE = 0.8  # of a pattern, and of an instance
LEAST_SEEDS = 4  # different seeds of a pattern, at least
UNKNOWN = 0.25  # what an instance of no known kind, that looks like the pattern's, counts against it
CHANCE = 0.01  # patterns of the whole corpus that chance may make

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is entered at its first digit only, and never given back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end (excluded), in code points


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """The local part of an address runs from the last match or the first sign that may not
    stand in it up to the at sign, so each at sign is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        domain = _DOMAIN.match(text, end) if start < at else None
        if domain:
            end = domain.end()
            yield EMAIL, start, end
        free, at = end, text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap, by kind and start."""
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = _NO_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15:
                found.append((PHONE, *m.span()))
    return found


_SIGN = re.compile(r"[0-9@]")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_WORD = re.compile(r"[^ \t-\r]+")
_EDGES = "\"'()[]{}<>,;.!?"
_GROUP = re.compile(r"[0-9().+/-]*[0-9][0-9().+/-]*(?: [0-9().+/-]*[0-9][0-9().+/-]*)*")
_IPV6 = re.compile(r"(?=(?:[^:]*:){2})[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}\Z")
_LETTER = re.compile(r"[A-Za-z]")


def looks(value: str) -> int:
    """Kinds (bits) that a token without a base form may be of."""
    digits = _NO_DIGITS.sub("", value)
    kinds = 0
    name, at, host = value.partition("@")
    if at and "@" not in host and _LETTER.search(name) and _LETTER.search(host):
        kinds |= 1 << EMAIL
    if _IPV6.match(value):
        kinds |= 1 << IP
    if not set(value).difference("0123456789 ().+/-"):
        kinds |= (13 <= len(digits) <= 19 and luhn(digits)) << CARD
        kinds |= (7 <= len(digits) <= 15) << PHONE
    return kinds


def instance(value: str) -> str:
    """What different writings of an identifier share: the digits of a number, else the
    lower-case text."""
    digits = _NO_DIGITS.sub("", value)
    if digits and not set(value).difference("0123456789 ()+/-"):
        return digits
    return value.lower()


def _word(word: str) -> str:
    """A word as it stands in a pattern: identifiers are all alike there."""
    word = word.strip(_EDGES).lower()
    return "0" if _SIGN.search(word) else word


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical contexts of a place: the word before it, two words, and the words on both sides."""
    left = [w for w in map(_word, text[max(0, start - 128) : start].split()) if w][-2:]
    right = [w for w in map(_word, text[end : end + 64].split()) if w][:1]
    near = left[-1][-24:] if left else "^"
    found = [f"{near} _"]
    if len(left) == 2:
        found.append(f"{left[0][-24:]} {near} _")
    if right:
        found.append(f"{near} _ {right[0][:24]}")
    return found


def tokens(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens that meet none of the `taken` spans (sorted); groups of digits with
    single spaces between are one."""
    at, k = 0, 0
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in _SPACE:
            start -= 1
        end = _WORD.match(text, start).end()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            at = max(end, taken[k][1])
            continue
        group = _GROUP.match(text, start)
        if group and group.end() >= end:
            limit = taken[k][0] if k < len(taken) else len(text)
            end = group.end() if group.end() <= limit else end
        at = end
        inner = text[start:end]
        # in `name=value` and `name:value` the name is a part of the context
        cut = max(inner.rfind("=", 0, m.start() - start), inner.rfind(":", 0, m.start() - start)) + 1
        if not cut or inner.count(":") < 2:
            start += cut
        while start < end and text[start] in _EDGES and text[start] != "(":
            start += 1
        while start < end and text[end - 1] in _EDGES:
            end -= 1
        if start < end:
            yield start, end


def occurrences(text: str, base: list[Span]) -> Iterator[dict]:
    """Seeds and other identifier-like tokens, with their patterns."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(s[1:] for s in base):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    for kind, start, end in base:
        yield _occurrence(text, start, end, kind, 1 << kind)
    for start, end in tokens(text, merged):
        yield _occurrence(text, start, end, -1, looks(text[start:end]))


def _occurrence(text: str, start: int, end: int, kind: int, kinds: int) -> dict:
    value = instance(text[start:end])
    return {
        "start": start, "end": end, "kind": kind, "looks": kinds, "value": value[:512], "patterns": patterns(text, start, end),
    }


_SPANS = "array<struct<kind:int,start:long,end:long>>"
_FOUND = "array<struct<start:long,end:long,kind:int,looks:int,value:string,patterns:array<string>>>"


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, base spans and occurrences of every document; a saved table."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    found = pa.struct(
        [
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("kind", pa.int32()),
            ("looks", pa.int32()),
            ("value", pa.string()),
            ("patterns", pa.list_(pa.string())),
        ]
    )
    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(span)), ("found", pa.list_(found))]
    )
    names = [f.name for f in span]

    def run(batches):
        give_back()
        for batch in batches:
            for part in slices(batch, 256):
                base = [base_spans(t) if t else [] for t in part.column("text").to_pylist()]
                seen = [
                    list(occurrences(t, b)) if t else [] for t, b in zip(part.column("text").to_pylist(), base)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([[dict(zip(names, s)) for s in b] for b in base], pa.list_(span)),
                        pa.array(seen, pa.list_(found)),
                    ],
                    schema=schema,
                )

    # the number only tells rows apart in the table that is saved here
    table = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return saved(table.mapInArrow(run, f"row long, doc_id long, base {_SPANS}, found {_FOUND}"), "personal-data")


def bootstrap(seen: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (pattern, kind, n_seeds, confidence) and instances that are no seeds
    (value, kind, score), from occurrences (value, kind, looks, patterns).

    An instance counts once for a pattern, however often copies of a text repeat both.  A
    pattern needs so many seeds of a kind that chance, by the kind's share of all instances,
    makes it only once in `1 / CHANCE` corpora of as many patterns.
    """
    edges = saved(
        seen.select("value", "looks", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value")
        .agg(F.bit_or("looks").alias("looks")),
        "personal-data-edges",
    )
    values = seen.groupBy("value").agg(
        F.bit_or(F.expr("if(kind >= 0, shiftleft(1, kind), 0)")).alias("seed"),
        F.bit_or("looks").alias("looks"),
    )
    values = saved(values, "personal-data-values")
    seed_of = [F.count_if(F.getbit("seed", F.lit(k)) == 1).alias(n) for k, n in enumerate(KINDS)]
    counts = values.agg(F.count("*").alias("all"), *seed_of).first()
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("size"))
    n_patterns = sizes.count()

    needed = F.lit(None).cast("double")
    for k, name in enumerate(KINDS):
        share = counts[name] / counts["all"] if counts["all"] else 1.0
        if 0 < share < 1:
            least = max(LEAST_SEEDS, math.log(max(2, n_patterns) / CHANCE) / -math.log(share))
            needed = F.when(F.col("kind") == k, F.lit(float(least))).otherwise(needed)

    def kinds_in(bits: str):
        return F.explode(F.filter(F.array(*[F.lit(k) for k in range(4)]), lambda k: F.getbit(bits, k) == 1))

    seeds = values.where("seed > 0").select("value", kinds_in("seed").alias("kind"))
    known = edges.join(seeds, "value").groupBy("pattern", "kind").agg(F.count("*").alias("n_seeds"))
    open_values = values.where("seed = 0 AND looks > 0").select("value")
    open_edges = saved(
        edges.where("looks > 0").join(open_values, "value").select("pattern", "value", kinds_in("looks").alias("kind")),
        "personal-data-edges",
    )
    open_sizes = open_edges.groupBy("pattern", "kind").agg(F.count("*").alias("open"))
    # what stands for and against a pattern does not change; what may be added is judged anew
    known = saved(
        known.where(F.col("n_seeds") >= needed)
        .join(sizes, "pattern")
        .join(open_sizes, ["pattern", "kind"], "left")
        .withColumn("open", F.coalesce("open", F.lit(0))),
        "personal-data-patterns",
    )
    scores = None
    for _ in range(max(1, rounds)):
        judged = known.withColumn("more", F.lit(0.0))
        if scores is not None:
            more = open_edges.join(scores, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("more"))
            judged = known.join(more, ["pattern", "kind"], "left")
        more = F.coalesce("more", F.lit(0.0))
        others = F.col("size") - F.col("open") + UNKNOWN * (F.col("open") - more)
        worth = (F.col("n_seeds") + more) / (others + more + 1)
        accepted = saved(
            judged.select("pattern", "kind", "n_seeds", worth.alias("confidence")).where(
                F.col("confidence") >= CONFIDENCE
            ),
            "personal-data-patterns",
        )
        against = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        scores = saved(
            open_edges.join(accepted, ["pattern", "kind"])
            .groupBy("value", "kind")
            .agg((1 - F.exp(against)).alias("score")),
            "personal-data-values",
        )
    return accepted, scores.where(F.col("score") >= CONFIDENCE)


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, `base` and `spans` of each row: arrays of (kind, start, end) in code points, end
    excluded, by kind and start; `spans` holds the base ones and those that the bootstrap adds,
    which meet no base span.

    Needs doc_id and text; other columns are not read.  A null text is empty and has no spans.
    Every row gives one, repeated rows too.  A value is compared by its first 512 signs.
    """
    table = scanned(docs)
    seen = table.select("row", F.inline("found"))
    _, values = bootstrap(seen, rounds)
    added = (
        seen.where("kind < 0 AND looks > 0")
        .select("row", "start", "end", "looks", "value")
        .join(values.select("value", F.col("kind").alias("known")), "value")
        .where(F.getbit("looks", F.col("known")) == 1)
        .groupBy("row")
        .agg(
            F.collect_set(
                F.struct(F.col("known").cast("int").alias("kind"), "start", "end")
            ).alias("added")
        )
    )
    spans = F.coalesce(F.array_sort(F.concat("base", "added")), F.col("base"))
    return table.select("row", "doc_id", "base").join(added, "row", "left").select("doc_id", "base", spans.alias("spans"))


def written(spans):
    """Spans as `kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def _only(kind: int):
    return lambda k: F.when(k == kind, k)


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as a text."""
    base = F.col("base")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [
        F.size(F.array_compact(F.transform(kinds, _only(k)))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
