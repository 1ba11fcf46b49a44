"""Parts that the trained classifiers share: bounded training samples and driver-side optimisation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import fold_of


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for the rows whose labels are never learned; a null id has no labels to learn."""
    return F.coalesce(fold_of(doc_id, folds) == fold, F.lit(False))


def labelled_ids(labels: DataFrame, column: str, folds: int, fold: int, per_class: int) -> DataFrame:
    """Ids and classes of training rows: at most per_class of each class, picked by a hash of the id.

    Rows with null id or class and ids with clashing labels are left out; repeated rows count once.
    """
    train = (
        labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id")
        .agg(F.min(column).alias("y"), F.max(column).alias("y_max"))
        .where("y = y_max")
        .select("doc_id", F.col("y").cast("int"), F.xxhash64("doc_id").alias("o"))
    )
    one = lambda c: train.where(F.col("y") == c).orderBy("o", "doc_id").limit(per_class)
    return one(0).unionByName(one(1)).drop("o")


def adam(
    loss_gradient: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, dims: int, epochs: int, batch: int, rate: float, seed: int = 7
) -> np.ndarray:
    """Minimises by Adam over shuffled batches: loss_gradient(weights, row numbers) gives a batch's gradient."""
    rng, w = np.random.default_rng(seed), np.zeros(dims)
    m, v, t = np.zeros(dims), np.zeros(dims), 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, n, batch):
            t += 1
            g = loss_gradient(w, order[i : i + batch])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
