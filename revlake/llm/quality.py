"""Quality classifier: positive-unlabelled learning by non-negative unbiased risk."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.hashing import BLOCK, words
from revlake.llm.linear import adam, held_out, labelled_ids, sigmoid

FOLDS, FOLD = 3, 1
#: Documented bounds of the training sample: trusted positives, and unlabelled texts.
POSITIVES, UNLABELLED = 4000, 8000

#: Byte classes: one for each of letters, capitals, digits, blanks, line ends and non-ASCII bytes, and one for each printable sign.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 11, 12, 32]], _CLASS[[10, 13]], _CLASS[128:] = 1, 2, 3, 4, 5, 6
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_SIGNS] = np.arange(7, 7 + len(_SIGNS))
CLASSES = 7 + len(_SIGNS)
EXTRA = 10
DIMS = CLASSES * CLASSES + CLASSES + EXTRA


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of byte-class pairs and byte classes, and shape numbers, of the whole text."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    pairs = np.zeros(CLASSES * CLASSES)
    for at in range(0, max(1, len(raw) - 1), BLOCK):
        c = _CLASS[raw[at : at + BLOCK + 1]]
        pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
    ones = pairs.reshape(CLASSES, CLASSES).sum(1)
    hashes, starts, ends = words(data)
    n, lines = len(hashes), Counter(x for x in data.split(b"\n") if x)
    if n:
        _, times = np.unique(hashes, return_counts=True)
        length = ends - starts
        shape = [len(times) / n, len(times) / n**0.8, times.max() / n, length.mean() / 10, length.std() / 10, 1 - len(lines) / max(1, lines.total()), np.log1p(lines.total() / n), np.log1p(n) / 10, 1 / n, 1.0]
    else:
        shape = [0.0] * EXTRA
    return np.concatenate([np.sqrt(pairs / max(1, pairs.sum())), np.sqrt(ones / max(1, ones.sum())), shape]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return sigmoid(z @ self.weights[:-1] + self.weights[-1])


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 30, batch: int = 256, rate: float = 0.01, penalty: float = 1e-3) -> np.ndarray:
    """Weights and intercept that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) for the logistic loss.

    In a batch whose second term is negative the step goes up that term instead (Kiryo et al., 2017).
    """
    return _nn_pu(np.vstack([positive, unlabelled]), len(positive), prior, epochs, batch, rate, penalty)


def _nn_pu(x: np.ndarray, positives: int, prior: float, epochs: int = 30, batch: int = 256, rate: float = 0.01, penalty: float = 1e-3) -> np.ndarray:
    """As nn_pu, for one matrix whose first rows are the positive ones: it is not copied."""

    def gradient(w, rows):
        part, p = x[rows], rows < positives
        if p.all() or not p.any():
            return np.zeros_like(w)
        z = part @ w[:-1] + w[-1]
        s = sigmoid(z)
        minus = np.logaddexp(0, z)  # loss of calling a row negative
        up = s / (~p).sum() * ~p - prior * s / p.sum() * p  # slope of the second term
        if minus[~p].mean() - prior * minus[p].mean() >= 0:
            e = up + prior * (s - 1) / p.sum() * p
        else:
            e = -up
        return np.append(part.T @ e + penalty * w[:-1], e.sum())

    return adam(gradient, len(x), x.shape[1] + 1, epochs, batch, rate)


def cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float, lost: float = 0.002) -> float:
    """Where to put a score of 0.5: the share of unlabelled rows above is the prior, but at most `lost` of the trusted rows fall below."""
    return float(min(np.quantile(unlabelled, 1 - prior), np.quantile(positive, lost)))


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled, from held-out scores of both (best bin estimation, Garg et al., 2021).

    Above any threshold there are at least as many unlabelled rows as the prior times the share of positives. The
    threshold is taken where the ratio's upper confidence bound is least: there the unlabelled rows above are the purest.
    """
    at = np.sort(positive)
    above_p = 1 - np.arange(len(at)) / len(at)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), at) / len(unlabelled)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(above_u[best] / above_p[best])


def _estimate(x: np.ndarray, positives: int) -> float:
    """prior_of by a classifier of trusted against unlabelled rows, trained on every second row and applied to the others."""
    y = (np.arange(len(x)) < positives).astype(np.float32)
    train = np.arange(0, len(x), 2)
    weight = np.where(y == 1, len(x) / max(1, positives), len(x) / max(1, len(x) - positives)) / 2

    def gradient(w, rows):
        rows = train[rows]
        part = x[rows]
        e = (sigmoid(part @ w[:-1] + w[-1]) - y[rows]) * weight[rows]
        return np.append(part.T @ e / len(rows) + 1e-2 * w[:-1], e.mean())

    w = adam(gradient, len(train), x.shape[1] + 1, epochs=10, batch=256, rate=0.01)
    z = x[1::2] @ w[:-1].astype(np.float32) + np.float32(w[-1])
    held = y[1::2] == 1
    return prior_of(z[held], z[~held]) if held.any() and not held.all() else 0.5


def _matrix(sample: DataFrame, most: int) -> tuple[np.ndarray, int]:
    """Features of the sample's texts, at most `most` rows, trusted ones first, and their number; filled batch by batch."""

    def run(batches):
        for batch in batches:
            data = [features(t.as_py()).tobytes() for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["y", "doc_id", "h", "x"])

    rows = sample.select("y", "doc_id", "h", "text").mapInArrow(run, "y int, doc_id bigint, h bigint, x binary")
    x, facts, n = np.empty((most, DIMS), np.float32), np.empty((most, 3), np.int64), 0
    for row in rows.toLocalIterator():
        x[n], facts[n], n = np.frombuffer(row.x, np.float32), (row.y, row.doc_id, row.h), n + 1
    order = np.lexsort((facts[:n, 2], facts[:n, 1], -facts[:n, 0]))  # the rows' order in the cluster must not matter
    return x[order], int((facts[:n, 0] == 1).sum())


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learns from at most `positives` trusted documents and `unlabelled` documents taken without any label.

    Trusted ones have quality 1 outside the held-out fold. Unlabelled text is every other document, labelled or not,
    outside that fold: no label of it is read, and the class prior among it is estimated from the features. Both samples
    are picked by a hash of the id. An id that several rows have counts once, with the text whose hash is smallest, so
    that repeated rows cannot grow the sample; rows with null ids are not learned from; null texts count as empty.
    Without positives or unlabelled rows, as in an empty table, the score is constant; further columns are ignored.
    """
    train = labelled_ids(labels, "quality", FOLDS, FOLD, positives).where("y = 1").select("doc_id", "y")
    ids = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD)).select(F.col("doc_id").cast("bigint"))
    ranked = ids.distinct().withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(positives + unlabelled)
    free = ranked.join(F.broadcast(train.select("doc_id")), "doc_id", "left_anti").orderBy("o", "doc_id").limit(unlabelled)
    chosen = train.unionByName(free.select("doc_id", F.lit(-1).alias("y")))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most positives + unlabelled ids
    rows = rows.groupBy("doc_id", "y").agg(F.min("h").alias("h"), F.min_by("text", F.struct("h", "text")).alias("text"))
    x, n = _matrix(rows, positives + unlabelled)
    if not n or n == len(x):
        return Model(np.zeros(DIMS), np.ones(DIMS), np.zeros(DIMS + 1), 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-2
    x -= mean
    x /= scale
    np.clip(x, -5, 5, out=x)
    prior = float(np.clip(_estimate(x, n), 0.02, 0.98))
    w = _nn_pu(x, n, prior)
    z = x @ w[:-1].astype(np.float32) + np.float32(w[-1])
    w[-1] -= cut(z[:n], z[n:], prior)
    return Model(mean, scale, w, prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    A null text scores as an empty one; a null doc_id is kept and counts as not held out; repeated
    rows score alike; an empty table gives no rows; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * DIMS numbers

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(2)], np.float32).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.score(x), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose whole text scores 0.5 or more.

    A null text scores as an empty one; repeated rows are kept or dropped alike; null ids do not matter; an empty table
    gives none; columns of any name pass through.
    """
    shared, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(text)], np.float32).reshape(-1, DIMS)
            yield batch.filter(pa.array(shared.value.score(x) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
