"""Labelled rows for the classifiers: folds, bounded samples, logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import fold_column


def training_labels(labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """doc_id and y (0 or 1) of the labelled rows outside the held-out fold.

    Rows without doc_id or label are left out; of several labels of a document the largest counts.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return known.filter(fold_column(folds) != held).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))


def least_hashes(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hashes of ``columns``, all if there are fewer.

    Rows whose hash lies above what ``n`` rows of the counted total need, with room for
    chance, are filtered where they are read. So about ``n`` rows reach the sort, however
    many rows or partitions the table has, unless very many of them hold the same values.
    """
    total = df.count()
    place = F.shiftrightunsigned(F.xxhash64(*columns), 1)
    if total > n:
        share = (n + 8 * n**0.5 + 16) / total
        df = df.filter(place <= F.lit(min((1 << 63) - 1, int(share * (1 << 63)))))
    return df.orderBy(place, *columns).limit(n)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge-penalised logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(x)) / 100)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
