"""Training rows of the classifiers: a bounded sample of labelled documents, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def training_docs(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text bytes, label int) of at most `most` labelled documents for whose id `train` holds, picked by hash of the id.

    Null labels and ids don't count; of several labels of one id the largest does. The sample's ids and labels are bounded by `most`, so they
    are broadcast to the scan of docs.
    """
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return given.join(F.broadcast(picked), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a logistic regression by Newton's method with soft targets; of no rows, those that always give one half."""
    n = len(y)
    a = np.column_stack((x, np.ones(n))) if n else np.zeros((0, x.shape[1] + 1))
    w = np.zeros(a.shape[1])
    if not n:
        return w
    pos = y.sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (n - pos + 2))  # Platt's targets: a certain answer needs many rows
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (p - goal) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ w, -35, 35)))
