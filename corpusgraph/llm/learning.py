"""Bounded training samples and a small logistic regression, used by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows of each class that a model is fitted on.
MAX_PER_CLASS = 4000


def held_out(doc_id: str, folds: int, fold: int) -> F.Column:
    """Rows that no model may learn from; a row without an id is none of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def known_labels(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """(doc_id, label) of the labelled rows outside the held-out fold, one a document."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id", folds, fold))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def share(labels: DataFrame, label: str, folds: int, fold: int) -> float | None:
    """The share of label 1 over all labelled rows outside the held-out fold, to weigh a sample's classes by."""
    return known_labels(labels, label, folds, fold).agg(F.avg("label")).first()[0]


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(doc_id, text, label) of at most per_class labelled rows of each class outside the held-out fold.

    The ids with the smallest hashes are taken, of rows that repeat an id the least text. At most 2 * per_class ids are broadcast.
    """
    known = known_labels(labels, label, folds, fold)
    took = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(took[0].unionByName(took[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, prior: float | None = None) -> np.ndarray:
    """Weights and, last, the intercept, by damped Newton steps; prior: the share of label 1 to weigh the classes by."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return np.concatenate([np.zeros(x.shape[1] if x.ndim == 2 else 0), [np.log(share / (1 - share))]])
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
    weight = np.ones(len(y)) if prior is None else np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(y))
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6)
        step = np.linalg.solve(curve, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    out = w.copy()
    out[:-1] = w[:-1] / scale
    out[-1] = w[-1] - (out[:-1] * center).sum()
    return out


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
