"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, doubtful insult, threat, target, negation, reported
speech, other).
Five transducers, composed into one machine, read the symbols of a clause: each
keeps what it has seen and marks the insults and threats that pass.  What comes
out are matched clauses of some kinds (insult, doubtful insult or threat; plain or
negated; direct or reported; with or without a target), and only they are scored.  A threat
without a target is no match.

The insult words and stems, and the weight of each kind, are learned from labelled
rows; the closed word classes are fixed.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import arrow_schema, map_batches, saved
from assetry.llm.fitting import TRAIN_ROWS, fit_logistic, held_out, sigmoid, training_sample

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END, DOUBTFUL = range(8)
# Closed word classes in English, German, French and Spanish.
THREATS = "kill hurt destroy beat shoot stab strangle punish töten schlagen tuer frapper matar golpear"
TARGETS = (
    "you your yours he she him her they them their those people all everyone anyone "
    "du dich dir ihr euch sie ihn alle tu te toi vous ils elles lui leur tous "
    "usted ustedes ellos ellas él ella todos"
)
NEGATIONS = "not never no nobody don't doesn't isn't aren't won't nicht kein keine nie pas jamais aucun nunca jamás"
REPORTS = (
    "said says say saying wrote writes called calls quoted quotes reported claimed allegedly "
    "sagte sagt schrieb nannte angeblich dit écrit déclaré dijo dice escribió llamó"
)
_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]").findall
_ENDS = frozenset(".!?;:\n")
_NEGATED, _REPORTED, _TARGETED = 1, 2, 4
_FAMILY = {INSULT: 0, THREAT: 8, DOUBTFUL: 16}
KINDS = 24

STEM_LENGTHS = (4, 5, 6)
STEM_WORDS = 5  # words a stem must be seen with
LEAST_SHARE, SURE_SHARE = 0.5, 0.9  # toxic clauses among those with an entry
EVIDENCE = 25.0  # log-likelihood ratio of an entry, at least


class Machine:
    """Deterministic transducer: (state, symbol) -> (state, output)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: "Machine") -> "Machine":
        """The machine whose second half reads what the first puts out."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Machine((self.start, other.start), step)

    def table(self, symbols) -> tuple[np.ndarray, np.ndarray]:
        """Reachable states as two tables: next state and output."""
        states, rows = {self.start: 0}, []
        queue = [self.start]
        for state in queue:
            row = []
            for s in symbols:
                following, out = self.step(state, s)
                if following not in states:
                    states[following] = len(states)
                    queue.append(following)
                row.append((states[following], out))
            rows.append(row)
        both = np.array(rows)
        return both[:, :, 0], both[:, :, 1]


# Outputs between the machines: symbol + 8 * marks; a match leaves as its kind.
def _marked(out: int, mark: int) -> int:
    return out | mark << 3


def _scope(symbol: int, mark: int, reach: int) -> Machine:
    """Marks insults and threats that follow `symbol` within `reach` words."""

    def step(left, out):
        kind = out & 7
        if kind == END:
            return 0, out
        if kind == symbol:
            return reach, out
        if kind in _FAMILY and left:
            out = _marked(out, mark)
        return max(0, left - 1), out

    return Machine(0, step)


def _threats(reach: int) -> Machine:
    """Holds a threat back until its target follows within `reach` words, and lets
    it out in the target's place; a threat with a target before it passes."""

    def step(state, out):
        held, left = state
        kind = out & 7
        if kind == END:
            return (0, 0), out
        if kind == THREAT:
            if out >> 3 & _TARGETED:
                return (0, 0), out
            return (out, reach), OTHER
        if kind == TARGET and left:
            return (0, 0), _marked(held, _TARGETED)
        if left <= 1:
            return (0, 0), out
        return (held, left - 1), out

    return Machine((0, 0), step)


def _kinds() -> Machine:
    """The kind of each match, and -1 for all else."""

    def step(state, out):
        symbol = out & 7
        if symbol not in _FAMILY:
            return state, -1
        return state, out >> 3 & 7 | _FAMILY[symbol]

    return Machine(0, step)


def grammar() -> Machine:
    return (
        _scope(NEGATION, _NEGATED, 3)
        .then(_scope(REPORT, _REPORTED, 12))
        .then(_scope(TARGET, _TARGETED, 5))
        .then(_threats(4))
        .then(_kinds())
    )


class Symbols(dict):
    """Symbol of each word, learned stems included; emptied when full."""

    LIMIT = 500_000

    def __init__(self, entries: dict[str, list[tuple[str, int]]]):
        super().__init__()
        fixed = ((NEGATIONS, NEGATION), (REPORTS, REPORT), (TARGETS, TARGET), (THREATS, THREAT))
        self.fixed = {w: s for text, s in fixed for w in text.split()} | dict.fromkeys(_ENDS, END)
        self.words = {w: s for w, s in entries.get("words", ())}
        self.stems = {w: s for w, s in entries.get("stems", ())}

    def _learned(self, word: str) -> int:
        if word in self.words:
            return self.words[word]
        for n in STEM_LENGTHS:
            if word[:n] in self.stems and len(word) > n:
                return self.stems[word[:n]]
        return OTHER

    def __missing__(self, word: str) -> int:
        symbol = self.fixed.get(word)
        if symbol is None:
            symbol = self._learned(word)
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = symbol
        return symbol


class Matcher:
    """Counts the matched clauses of a text by kind."""

    def __init__(self, entries):
        self.symbols = Symbols(entries)
        following, output = grammar().table(range(8))
        self.following, self.output = following.tolist(), output.tolist()

    def __call__(self, text: str | None) -> list[int]:
        counts = [0] * KINDS
        if not text:
            return counts
        row = bytes(map(self.symbols.__getitem__, _TOKENS(text.lower())))
        if not any(symbol in row for symbol in _FAMILY):
            return counts
        for clause in row.split(bytes([END])):
            if any(symbol in clause for symbol in _FAMILY):
                state, seen = 0, set()
                for symbol in clause:
                    kind = self.output[state][symbol]
                    state = self.following[state][symbol]
                    if kind >= 0:
                        seen.add(kind)
                for kind in seen:
                    counts[kind] += 1
        return counts


def features(counts: np.ndarray) -> np.ndarray:
    """A first matched clause of a kind counts one, each further one less."""
    return np.log2(1 + counts)


def prior_weights() -> np.ndarray:
    """Where nothing is learned: a match speaks for toxicity, less so if negated or
    reported, more so with a target or as a threat; the constant against it."""
    out = []
    for family, target, report, negated in product((6.0, 7.0, 2.5), (0, 1), (0, 1), (0, 1)):
        out.append(family + 0.5 * target - 2.5 * report - 3.0 * negated)
    return np.array([*out, -4.0])


def lexicon(sample: DataFrame) -> dict[str, list[tuple[str, int]]]:
    """Insult words and stems of labelled rows (text, y): those that mark clauses of
    toxic documents beyond chance.  A clause counts once, however many copies the
    sample has of it, and as clean if a clean document has it.  A stem must come with
    several endings.  Entries that clean clauses have too, in one of ten or more, are
    doubtful.  Gives the symbol of each word and stem."""
    schema = arrow_schema("word string, toxic long, clean long")

    def count(batches):
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                seen[y != 1].update({w for w in _TOKENS((text or "").lower()) if w not in _ENDS})
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)],
                schema=schema,
            )

    clause = F.explode(F.split(F.lower("text"), r"[.!?;:\n]"))
    clauses = saved(
        sample.select("y", clause.alias("text")).groupBy("text").agg(F.min("y").alias("y")), "clauses"
    )
    n = clauses.agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("toxic"), F.count(F.when(F.col("y") == 0, 1)).alias("clean")
    ).first()
    if not n.toxic or not n.clean:
        return {}
    words = saved(
        clauses.mapInArrow(count, "word string, toxic long, clean long")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
        "word-counts",
    )
    share = n.toxic / (n.toxic + n.clean)

    def telling(df: DataFrame) -> list[tuple[str, int]]:
        a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")

        def part(k, p):
            return F.when(k > 0, k * F.log(k / ((a + b) * p))).otherwise(0.0)

        found = (
            df.where("toxic > 0")
            .withColumn("evidence", 2 * (part(a, share) + part(b, 1 - share)))
            .where((F.col("evidence") >= EVIDENCE) & (a >= LEAST_SHARE * (a + b)))
            .orderBy(F.desc("evidence"), "word")
            .select("word", (a >= SURE_SHARE * (a + b + 1)).alias("sure"))
        )
        return [(r.word, INSULT if r.sure else DOUBTFUL) for r in found.collect()]

    by_stem = (
        words.withColumn("size", F.explode(F.array(*map(F.lit, STEM_LENGTHS))))
        .where(F.length("word") > F.col("size"))
        .groupBy(F.expr("substr(word, 1, size)").alias("word"))
        .agg(
            F.sum("toxic").alias("toxic"),
            F.sum("clean").alias("clean"),
            F.count(F.when(F.col("toxic") > 0, 1)).alias("endings"),
        )
        .where(F.col("endings") >= STEM_WORDS)
    )
    return {"words": telling(words), "stems": telling(by_stem)}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Model from labelled rows that are not held out: insult words and stems, and the
    weight of each kind.  They come from `rows` rows at most, whose words bound the entries."""
    sample = saved(training_sample(docs, labels, "toxic", rows), "toxic-sample")
    entries = lexicon(sample)

    def make():
        match = Matcher(entries)

        def turn(batch):
            return {
                "y": batch.column("y"),
                "counts": [match(t) for t in batch.column("text").to_pylist()],
            }

        return turn

    # at most `rows` rows of a few numbers
    seen = map_batches(sample.select("text", "y"), make, "y int, counts array<long>").collect()
    x = features(np.array([r.counts for r in seen], dtype=float).reshape(-1, KINDS))
    y = np.array([r.y for r in seen], dtype=float)
    weights = fit_logistic(x, y, prior_weights(), strength=0.1)
    return {"entries": entries, "weights": weights}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of `docs` (text, ...) with `toxic_score`, `toxic_clauses` after
    them: the score from 0 to 1, and the matched clauses by kind.  Null and empty
    texts have no match and the score of a text without one."""
    weights = model["weights"]

    def make():
        match = Matcher(model["entries"])

        def turn(batch):
            counts = [match(t) for t in batch.column("text").to_pylist()]
            x = features(np.array(counts, dtype=float).reshape(-1, KINDS))
            return {"toxic_score": sigmoid(x @ weights[:-1] + weights[-1]), "toxic_clauses": counts}

        return turn

    return map_batches(docs, make, "toxic_score double, toxic_clauses array<long>", keep=True)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every row of `docs` (doc_id, text): (doc_id, held_out, score, predicted,
    clauses).  Labels (doc_id, toxic) are learned from rows only whose
    crc32(doc_id as text) mod 5 is not 0.  Null ids are not held out.  Rows of one id
    are scored each for itself.  Other columns are not read; without labels the
    grammar's own weights hold and no insult is known."""
    own = docs.select("doc_id", "text")
    scored = score(own, fit(own, labels, rows))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
        F.col("toxic_clauses").alias("clauses"),
    )
