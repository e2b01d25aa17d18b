"""Document quality by hierarchical empirical Bayes.

A logistic classifier on a document's own measurements gives its evidence.  Means
of the evidence per host and per path of a host are shrunk: a path toward its host,
a host toward the whole, the more so the fewer documents it has.  How strongly is
estimated from the table itself (method of moments).  A document's score is its
evidence moved by what its path says beyond the whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import fresh, map_batches, saved
from assetry.llm.fitting import TRAIN_ROWS, fit_logistic, sigmoid, training_sample

SITE_WEIGHT = 0.3  # weight of the path's log-odds beside the document's own
MAX_STRENGTH = 1_000.0  # documents a prior counts as, at most
KEEP = 0.5
MARKS = "#*$%&|<>!"
N_FEATURES = 9


def measurements(text: str | None) -> tuple[float, ...]:
    """What the classifier sees of a text; all but the size are shares or ratios."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return (0.0,) * N_FEATURES
    marks = sum(map(text.count, MARKS)) / n
    distinct = len(set(words)) / n
    expected = 1.0 / (1.0 + np.log1p(n) / 8.0)  # long texts repeat their words more
    same = sum(map(str.__eq__, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x.strip()]
    runs = set(zip(words, words[1:], words[2:], words[3:]))
    return (
        float(np.log1p(n)),
        min(marks, 1.0),
        max(0.0, expected - distinct),
        same,
        sum(map(str.isupper, words)) / n,
        1.0 - len(set(lines)) / len(lines),
        1.0 - len(runs) / (n - 3) if n > 3 else 0.0,
        abs(len(text) / n - 6.0) / 6.0,
        words.count("|") / n,
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the classifier, from at most `rows` labelled rows (quality) that
    are not held out; those and the measurements of each are all the driver gets."""

    def make():
        def turn(batch):
            return {
                "y": batch.column("y"),
                "x": [list(measurements(t)) for t in batch.column("text").to_pylist()],
            }

        return turn

    sample = training_sample(docs, labels, "quality", rows).select("text", "y")
    seen = map_batches(sample, make, "y int, x array<double>").collect()
    x = np.array([r.x for r in seen], dtype=float).reshape(-1, N_FEATURES)
    y = np.array([r.y for r in seen], dtype=float)
    prior = np.zeros(N_FEATURES + 1)
    prior[-1] = 2.0  # without labels a document is taken for good
    return fit_logistic(x, y, prior, strength=0.01)


def with_evidence(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All columns of `docs` (text, ...) and `quality_evidence` after them."""

    def make():
        def turn(batch):
            x = np.array([measurements(t) for t in batch.column("text").to_pylist()], dtype=float)
            return {"quality_evidence": sigmoid(x.reshape(-1, N_FEATURES) @ weights[:-1] + weights[-1])}

        return turn

    return map_batches(docs, make, "quality_evidence double", keep=True)


def strength(mean: float, groups: int, total: float, squares: float, between: float) -> float:
    """Documents that a prior counts as: the beta distribution whose spread is that of
    the group means beyond what their sizes explain.

    `total` documents in `groups` groups, `squares` the sum of the squared sizes and
    `between` the size-weighted squared distance of the group means from `mean`."""
    spread = mean * (1 - mean)
    if groups < 2 or spread <= 0 or total <= 0:
        return MAX_STRENGTH
    free = total - squares / total
    beyond = (between - (groups - 1) * spread) / free if free > 0 else 0.0
    if beyond <= 0:
        return MAX_STRENGTH
    return float(np.clip(spread / beyond - 1, 1.0, MAX_STRENGTH))


def posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, host_mean, path_mean, mean) from rows (host, path,
    quality_evidence): one row per path.  Sums combine before the shuffle, so a host
    with a third of all documents is a few rows."""
    paths = saved(
        evidence.groupBy("host", "path").agg(
            F.count("*").alias("n"), F.sum("quality_evidence").alias("s")
        ),
        "paths",
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))

    def moments(df: DataFrame, n: str, s: str, mean) -> dict:
        away = F.col(s) / F.col(n) - mean
        return df.agg(
            F.count("*").alias("groups"),
            F.sum(n).cast("double").alias("total"),
            F.sum(F.col(n).cast("double") ** 2).alias("squares"),
            F.sum(F.col(n) * away * away).alias("between"),
        ).first().asDict()

    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(whole.s / whole.n, 1e-6), 1 - 1e-6) if whole.n else 0.5
    k_host = strength(mean, **{k: v or 0 for k, v in moments(hosts, "host_n", "host_s", mean).items()})
    joined = paths.join(
        hosts.withColumn("host_mean", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)), "host"
    )
    own = F.col("host_s") / F.col("host_n")
    k_path = strength(mean, **{k: v or 0 for k, v in moments(joined, "n", "s", own).items()})
    return joined.select(
        "host",
        "path",
        "host_mean",
        ((F.col("s") + k_path * F.col("host_mean")) / (F.col("n") + k_path)).alias("path_mean"),
        F.lit(mean).alias("mean"),
    )


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def score(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    rows: int = TRAIN_ROWS,
    site_weight: float = SITE_WEIGHT,
    keep_text: bool = True,
) -> DataFrame:
    """All columns of `docs` (doc_id, text, and the columns named as host and path)
    with quality_evidence, host_mean, path_mean, quality_score and quality_kept.

    `labels` (doc_id, quality) are learned from rows only that are not held out; with
    none, every document is taken for good.  Null hosts and paths are a host and a
    path of their own.  Null and empty texts measure zero.  Rows are scored each for
    itself, whatever their ids; other columns pass, but for those of the result's
    names, which are replaced.  An empty table gives none.  The measured table is saved
    once, with the texts unless `keep_text` is false.
    """
    weights = fit(docs, labels, rows)
    named = ("quality_evidence", "host_mean", "path_mean", "quality_score", "quality_kept")
    docs = docs.drop(*named)

    def keys(df: DataFrame, *more: str) -> DataFrame:
        return df.select(
            *more,
            F.struct(F.col(host).cast("string").alias("v")).alias("host"),
            F.struct(F.col(path).cast("string").alias("v")).alias("path"),
        )

    # measured once; what follows reads the saved table
    measured = saved(
        with_evidence(docs, weights).drop(*([] if keep_text else ["text"])), "evidence"
    )
    site, mean = fresh("site", measured.columns), fresh("mean", measured.columns)
    table = posteriors(keys(measured, "quality_evidence"))
    # the key is one binary-comparable text, null told from empty
    table = table.select(
        F.to_json(F.struct("host", "path")).alias(site), "host_mean", "path_mean", F.col("mean").alias(mean)
    )
    key = F.to_json(
        F.struct(
            F.struct(F.col(host).cast("string").alias("v")).alias("host"),
            F.struct(F.col(path).cast("string").alias("v")).alias("path"),
        )
    )
    scored = measured.withColumn(site, key).join(saved(table, "posteriors"), site, "left")
    odds = _log_odds(F.col("quality_evidence")) + site_weight * (
        _log_odds(F.col("path_mean")) - _log_odds(F.col(mean))
    )
    return (
        scored.withColumn("quality_score", 1 / (1 + F.exp(-odds)))
        .withColumn("quality_kept", F.col("quality_score") >= KEEP)
        .drop(site, mean)
    )
