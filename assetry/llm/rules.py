"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and
one bit per failed rule; a policy is a mask of the rules that reject, so that
versions of a policy, and what each rule adds to it, come from the bits alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import WordHashes, byte_words, map_batches, window_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
REPEAT_WINDOW = 8
MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, "
    "n_dup_lines long, n_repeat_words long, n_distinct_words long"
)


@dataclass(frozen=True)
class Rule:
    """A document fails where `fails`, SQL over the measurements, is true."""

    name: str
    fails: str


# Bit i is rule i: rules are added at the end and never change their place.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 2"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    # under a quarter of a short text, and of a long one a share that falls with its length
    Rule("few_distinct_words", "n_distinct_words * (1000 + n_words) < 250 * n_words"),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "1": BASE,
    "2": (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "few_distinct_words"),
}
POLICY = "2"


def mask(rules: tuple[str, ...]) -> int:
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[n] for n in rules)


def repeated_words(hashes: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words within runs of `window` words that stand twice or more."""
    runs = window_hashes(hashes, window)
    if len(runs) < 2:
        return 0
    _, kind, count = np.unique(runs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[kind] > 1)
    marks = np.zeros(len(hashes) + 1, dtype=np.int64)
    marks[starts] += 1
    marks[starts + window] -= 1
    return int((np.cumsum(marks) > 0).sum())


def measure(docs: DataFrame) -> DataFrame:
    """Measurements of whole texts (null: empty), one row per row of `docs`."""

    def make():
        known = WordHashes()

        def one(text: str) -> tuple[int, ...]:
            words = byte_words(text)
            lines = [x for x in text.split("\n") if x.strip(BLANKS)]
            hashes = known.of(words)
            return (
                len(words),
                len(text) - sum(map(text.count, BLANKS)),
                sum(map(text.count, SYMBOLS)),
                len(lines),
                len(lines) - len(set(lines)),
                repeated_words(hashes),
                len(set(words)),
            )

        def turn(batch):
            found = [one(t or "") for t in batch.column("text").to_pylist()]
            names = [f.split()[0] for f in MEASURES.split(",")][1:]
            columns = list(zip(*found)) if found else [()] * len(names)
            return {"doc_id": batch.column("doc_id")} | dict(zip(names, columns))

        return turn

    return map_batches(docs.select("doc_id", "text"), make, MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements of `docs` (doc_id, text) with `failed`, the bits of all rules.

    Null and empty texts measure zero and so fail `few_words`; rows with null or
    equal ids are measured each for itself; other columns are not read."""
    failed = sum(
        (F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(0) for i, r in enumerate(RULES)),
        F.lit(0),
    )
    return measure(docs).withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """Add `base_failed` and `kept`: no rule of the policy fails."""
    bits = F.col("failed")
    return rows.withColumn("base_failed", bits.bitwiseAND(mask(BASE)) != 0).withColumn(
        "kept", bits.bitwiseAND(mask(POLICIES[policy]) | mask(BASE)) == 0
    )


def ablation(rows: DataFrame, policy: str = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, those that fail it alone (kept
    without it), and those rejected at all.  Rows are first counted by their bits, so
    what is shuffled is one row per combination met."""
    own = mask(POLICIES[policy])
    counts = rows.groupBy(F.col("failed").bitwiseAND(own).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(
        F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).alias("bit")) for n in POLICIES[policy]))
    )
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        counts.withColumn("r", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_alone"),
            F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        )
    )


# DuckDB counterpart of op8: measurements, base rules and the policy's verdict.
LEDGER_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text,
    [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x <> ''] AS words,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM d
), runs AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_distinct(words)) AS n_distinct_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 2
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR n_distinct_words * (1000 + n_words) < 250 * n_words) AS kept
FROM b
"""
