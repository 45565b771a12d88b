"""Folds, bounded labelled samples and a small logistic regression for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most: those with the smallest hashes of their id.
FIT_ROWS = 8000
#: Longest text, in bytes of UTF-8, that a labelled sample takes: a sample has at most FIT_ROWS * FIT_BYTES bytes.
FIT_BYTES = 16 << 10


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of fitting: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, rows: int, key: str, *more: str, keep: Column | None = None) -> DataFrame:
    """At most ``rows`` rows of ``df`` that pass ``keep``, those with the smallest hashes of ``key`` and ``more``.

    ``more`` spreads rows whose key is null or repeats. A large number of such rows is thinned by that hash
    first, so that partitions don't each send ``rows`` rows.
    """
    df = df if keep is None else df.where(keep)
    total, order = df.count(), F.xxhash64(key, *more)
    if total > 4 * rows:
        df = df.where(F.pmod(order, F.lit(1 << 30)) < F.lit(int((1 << 30) * 4 * rows / total)))
        order = F.pmod(order, F.lit(1 << 30))
    return df.orderBy(order, key, *more).limit(rows)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents outside the held-out fold, one row an id.

    An id labelled twice counts as 1 if any of its labels is; null labels don't count. Of an id's texts of at most
    ``FIT_BYTES`` bytes, the one with the smallest hash is taken, so an id that owns a third of all rows weighs
    like any other.
    """
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), rows, "doc_id")
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    short = texts.where(F.octet_length("text") <= FIT_BYTES)
    found = short.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` pairs of numbers
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "label")).alias("one")  # folded before the shuffle
    return found.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def calibrated(features: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Probabilities, rounded so that the place of a row in its batch doesn't show."""
    return np.round(sigmoid(coefficients[0] + features @ coefficients[1:]), 9)


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 30, weights: np.ndarray | None = None) -> np.ndarray:
    """Coefficients, the intercept first, by Newton steps under a ridge penalty."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.ones(len(x)) if weights is None else weights
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ beta)
        slope = x.T @ (w * (labels - p)) - penalty @ beta
        curve = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta
