"""Labelled rows for fitting, and the fit of one logistic curve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents: those of
    smallest hash among the labels that ``keep`` allows."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(keep(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    chosen = hash_sample(chosen, "doc_id", rows).withColumnRenamed("doc_id", "_id")
    # bounded by ``rows``
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression, the last one its bias, by Newton's method."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
