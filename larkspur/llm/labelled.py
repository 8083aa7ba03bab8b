"""A bounded sample of labelled rows, and the logistic functions that the trained operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(id_col: Column, folds: int = 5) -> Column:
    """CRC-32 of the identifier as text, modulo ``folds``; 0 is the held-out fold, -1 a null identifier."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(-1)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``most`` labelled rows outside the held-out fold, the first by a hash of the identifier.

    Identifiers with different labels are left out. The chosen identifiers, at most ``most``, are broadcast.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("_id IS NOT NULL AND label IS NOT NULL")
    one = known.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).filter("label = _other AND label IN (0, 1)").drop("_other")
    chosen = one.filter(fold_of(F.col("_id")) != 0).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.join(F.broadcast(chosen), "_id").select(F.col("_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift that turn a margin into a probability, by Newton's method on smoothed labels."""
    n1, n0 = label.sum(), (1 - label).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        grad = x @ (p - goal) + np.array([1e-3 * (a - 1), 0])
        hess = (x * (p * (1 - p))) @ x.T + np.eye(2) * 1e-3
        step = np.linalg.solve(hess, grad)
        step *= min(1, 5 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3)), float(b)
