"""Bounded training samples and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5
TRAIN_ROWS = 10_000  # labelled rows that a classifier is fitted on, at most


def held_out(doc_id="doc_id"):
    """crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled rows that are not held out, chosen
    by a hash of their id, and one row of each id by a hash of its text.  Null labels
    do not count; of several labels of one id the largest does."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # combined before the shuffle: an id of very many rows is one row per task
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(
        "doc_id", "text", "y"
    )


def fit_logistic(
    x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, strength: float = 1.0, steps: int = 30
) -> np.ndarray:
    """Weights (the last for the constant) by Newton's method, drawn to `prior` as by
    a Gaussian; without rows the prior itself."""
    x = np.hstack((x, np.ones((len(x), 1))))
    prior = np.zeros(x.shape[1]) if prior is None else np.asarray(prior, dtype=float)
    pull = np.full(x.shape[1], strength)
    pull[-1] = min(strength, 0.01)
    w = prior.copy()
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + pull * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
