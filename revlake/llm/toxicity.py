"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.hashing import BLOCK
from revlake.llm.linear import adam, held_out, labelled_ids, sigmoid

FOLDS, FOLD = 5, 0
#: Documented bounds of the training sample: rows of each class.
PER_CLASS = 3000
#: Character n-grams of these lengths.
ORDERS = (4, 5, 6, 7)
BITS = 24
FEATURES = 4096
#: The sample is counted in this many partitions, each sending one compressed count table to the driver.
PARTS = 6

_STEP = np.uint32(0x01000193)


def _codes(text: str | None) -> np.ndarray:
    """One number per character of the text in small letters, with any of tab to carriage return as a space, padded by one space on each side."""
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    raw = np.where((raw >= 9) & (raw <= 13), np.uint32(32), raw) * np.uint32(0x9E3779B1)
    return raw ^ (raw >> np.uint32(15))


def _grams(code: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of each order's n-grams, as BITS-bit numbers."""
    h = code
    for n in range(2, max(ORDERS) + 1):
        if len(code) < n:
            return
        h = h[:-1] * _STEP + code[n - 1 :]
        if n in ORDERS:
            x = h ^ (h >> np.uint32(15))
            x = x * np.uint32(0x2C1B3C6D) + np.uint32(n)
            yield (x ^ (x >> np.uint32(13))) >> np.uint32(32 - BITS)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Blocks of n-gram hashes of the whole text; neighbouring blocks overlap by the longest n-gram."""
    codes = _codes(text)
    for at in range(0, max(1, len(codes) - max(ORDERS) + 1), BLOCK):
        yield from _grams(codes[at : at + BLOCK + max(ORDERS) - 1])


@dataclass
class Model:
    """Weights of the kept n-grams (sorted hashes) and the intercept."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self._known = None

    def present(self, text: str | None) -> np.ndarray:
        """Positions in keys of the kept n-grams that the text has."""
        if self._known is None:
            self._known = np.zeros(1 << BITS, bool)
            self._known[self.keys] = True
        found = [x[self._known[x]] for x in grams(text)]
        return np.searchsorted(self.keys, np.unique(np.concatenate(found))) if found else np.zeros(0, np.int64)

    def score(self, text: str | None) -> float:
        return float(sigmoid(np.float64(self.bias + self.weights[self.present(text)].sum())))

    def __getstate__(self):
        return {"keys": self.keys, "weights": self.weights, "bias": self.bias, "_known": None}


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that have each n-gram: an array of 2 by 2**BITS, and the class sizes."""

    def count(batches):
        seen, n = ([], []), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                y = y.as_py()
                n[y] += 1
                if found := list(grams(text.as_py())):
                    seen[y].append(np.unique(np.concatenate(found)).astype(np.uint32))
        for y in (0, 1):
            if n[y]:
                keys, times = np.unique(np.concatenate(seen[y] or [np.zeros(0, np.uint32)]), return_counts=True)
                data = [zlib.compress(x.astype(kind).tobytes(), 1) for x, kind in ((keys, np.uint32), (times, np.uint16))]
                yield pa.RecordBatch.from_pydict({"y": [y], "n": [n[y]], "keys": [data[0]], "times": [data[1]]})

    total, sizes = np.zeros((2, 1 << BITS), np.uint16), np.zeros(2, np.int64)
    rows = sample.select("text", "y").repartition(PARTS).mapInArrow(count, "y bigint, n bigint, keys binary, times binary")
    for row in rows.toLocalIterator():
        total[row.y][np.frombuffer(zlib.decompress(row["keys"]), np.uint32)] += np.frombuffer(zlib.decompress(row.times), np.uint16)
        sizes[row.y] += row.n
    return total, sizes


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from a sample of at most per_class rows of each class, outside the held-out fold.

    Ratios r = log((n1 + 1) / (N1 + 2)) - log((n0 + 1) / (N0 + 2)) over the sample's documents scale the
    presence of each n-gram; the FEATURES n-grams with the most chi-squared weight are kept, and logistic
    regression with an L2 penalty is trained on them. An id that several rows have counts once, with the text whose
    hash is smallest; rows with null ids are not learned from; null texts count as empty. Without rows of both classes,
    as in an empty table, the score is constant; further columns are ignored.
    """
    ids = labelled_ids(labels, "toxic", FOLDS, FOLD, per_class)
    share = labels.where(~held_out(F.col("doc_id"), FOLDS, FOLD) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids
    sample = sample.groupBy("doc_id", "y").agg(F.min("h").alias("h"), F.min_by("text", F.struct("h", "text")).alias("text"))
    counts, (n0, n1) = _counts(sample)
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0 if share is None else float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -5, 5)))
    c0, c1 = counts.astype(np.float32)
    keys = np.flatnonzero(c0 + c1 >= min(5, n1))
    c0, c1 = c0[keys], c1[keys]
    expect = (c0 + c1) * (n1 / (n0 + n1))
    chi = (c1 - expect) ** 2 / (expect + 1e-9)
    best = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
    keys, c0, c1 = keys[best], c0[best], c1[best]
    ratio = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
    probe = Model(keys, ratio, 0.0)

    def presence(batches):
        for batch in batches:
            at = [probe.present(t.as_py()).astype(np.int32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), *batch.columns[1:]], ["at", "y", "doc_id", "h"])

    rows = sample.select("text", "y", "doc_id", "h").mapInArrow(presence, "at array<int>, y int, doc_id bigint, h bigint").toArrow()
    y = np.array(rows["y"].to_pylist(), np.float64)
    x = np.zeros((len(y), len(keys)), np.float32)
    for i, at in enumerate(rows["at"]):
        x[i, at.values.to_numpy()] = 1
    order = np.lexsort((rows["h"].to_numpy(), rows["doc_id"].to_numpy(), y))  # the rows' order in the cluster must not matter
    x, y = x[order] * ratio.astype(np.float32), y[order]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))  # back to the labels' class shares

    def gradient(w, rows):
        part = x[rows]
        e = (sigmoid(part @ w[:-1].astype(np.float32) + w[-1]) - y[rows]) * weight[rows]
        return np.append(part.T @ e.astype(np.float32) / len(rows) + 1e-3 * w[:-1], e.mean())

    w = adam(gradient, len(y), len(keys) + 1, epochs=40, batch=128, rate=0.02)
    return Model(keys, (w[:-1] * ratio).astype(np.float64), float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    A null text scores as an empty one; a null doc_id is kept and counts as not held out; repeated
    rows score alike; an empty table gives no rows; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([shared.value.score(t.as_py()) for t in batch.column(2)], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
