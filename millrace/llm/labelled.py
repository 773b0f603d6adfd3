"""Bounded samples of labelled documents for the classifiers, and logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import hashed_sample


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id is the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label and text of at most per_class labelled documents of each class outside the held-out remainder.

    Those with the smallest hashes of their ids are taken; ids with several different labels, null labels and null
    texts are left out. The ids that are broadcast are 2 * per_class at most.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("_most"))
    one = one.where((F.col("label") == F.col("_most")) & (id_remainder(F.col(id_col), modulus) != held_out)).select(F.col(id_col).alias("_id"), "label")
    counts = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    taken = [hashed_sample(one.where(F.col("label") == c), F.xxhash64("_id"), per_class, counts.get(c, 0)) for c in (0, 1)]
    ids = F.broadcast(taken[0].union(taken[1]))
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col).alias("text")).join(ids, F.col(id_col) == F.col("_id")).select(F.xxhash64("_id").alias("draw"), "label", "text")


def base_rate(labels: DataFrame, label_col: str, modulus: int, held_out: int, id_col: str = "doc_id") -> float:
    """Share of label 1 among all labels outside the held-out remainder, kept off 0 and 1."""
    own = labels.where(F.col(label_col).isin(0, 1) & (id_remainder(F.col(id_col), modulus) != held_out))
    got = own.agg(F.sum(F.col(label_col).cast("double")).alias("ones"), F.count(F.lit(1)).alias("n")).first()
    return ((got["ones"] or 0.0) + 0.5) / (got["n"] + 1.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray = 0.05, steps: int = 30, prior: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; ridge (one, or one for each weight) pulls towards the prior, or to 0."""
    w = np.zeros(x.shape[1])
    start = w if prior is None else prior
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge * np.ones(len(w)))
        move = np.linalg.solve(hess, x.T @ (y - p) - ridge * (w - start))
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w
