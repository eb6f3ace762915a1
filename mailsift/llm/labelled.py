"""Bounded samples of labelled documents, and a small weighted logistic fit for calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.operators.scaling import cut_lineage


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 without an id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(-1)).cast("int")


def sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """Up to ``per_class`` documents of each class (doc_id, text, y), and the weight of a row of each.

    ``learn`` says which label rows may be used. The rows with the least hash of their id are taken, so
    the sample is the same in every run. Only its ids are broadcast; of a repeated label the larger counts,
    labels other than 0 and 1 are left out.
    """
    rows = labels.filter(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    parts = [
        rows.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    ids = cut_lineage(parts[0].unionByName(parts[1]))
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    taken = cut_lineage(texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y"))
    got = {r["y"]: r["count"] for r in taken.groupBy("y").count().collect()}
    return taken, {y: totals[y] / n for y, n in got.items()}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients (the constant last) of a logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve + 1e-9 * np.eye(len(w)), slope)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(w: np.ndarray, x) -> float:
    z = float(np.dot(w[:-1], x) + w[-1])
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))
