"""Labelled samples of bounded size, and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(mod: int = 3):
    """Column: whether a row is kept out of the fit: crc32 of doc_id's digits leaves 1 (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, mod: int = 3) -> DataFrame:
    """text and y (0 or 1) of at most ``rows`` labelled rows outside the held-out ones, chosen by a hash of doc_id.

    The sample's ids are broadcast: ``rows`` bounds them. Rows without doc_id or label are not used.
    """
    y = F.col(label).cast("int")
    ids = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & ~held_out(mod)).select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y"))
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last one is the intercept, which is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = sigmoid(x @ w)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ w)
        w = w + np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-8:
            break
    return w
