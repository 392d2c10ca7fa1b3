"""Helpers for operators that learn from labels: folds, bounded samples and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): one 0/1 label for each id; the larger of several, null labels left out."""
    y = F.col(column).cast("int")
    return labels.where(F.col("doc_id").isNotNull() & y.isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(y > 0, 1).otherwise(0)).alias("y"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Coefficients, intercept last, by Newton's method with a ridge on all but the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def area(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve; ties count one half."""
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    rank, n1 = (ends - counts / 2 + 0.5)[inverse], y.sum()
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * (len(y) - n1)))
