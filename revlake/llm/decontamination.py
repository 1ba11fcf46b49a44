"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import Workspace, fresh
from revlake.llm.hashing import MARKS, mix, shingles, words

#: Words of a seed. One shared seed makes a passage a candidate, however common the seed is.
SEED = 4
#: Alignment by words: a match, a mismatch, a gap of one word.
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: A copy aligns with at least this share of the item's words, and this many words (or the whole of a shorter item).
THRESHOLD, LEAST = 0.5, 8
#: Bits of the filter that scans the corpus for seeds: its size does not depend on the benchmark's.
FILTER_BITS = 1 << 24


def _cells(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(FILTER_BITS - 1)
    return (seeds & top).astype(np.int64), (mix(seeds ^ np.uint64(0xA5A5)) & top).astype(np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of word hashes (Smith and Waterman, 1981): score, and the end words in item and passage (exclusive).

    Memory is one row of the table; a row's horizontal gaps come from one running maximum.
    """
    shift = -GAP * np.arange(len(passage) + 1)
    row, best = np.zeros(len(passage) + 1), (0.0, 0, 0)
    for i, word in enumerate(item):
        step = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        row = np.concatenate([[0.0], np.maximum(step, 0)])
        row = np.maximum.accumulate(row + shift) - shift
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (float(row[at]), i + 1, at)
    return best


def reach(item: np.ndarray, passage: np.ndarray) -> int:
    """Words that the two have in common, each as often as both have it: no alignment scores more."""
    distinct, times = np.unique(item, return_counts=True)
    ordered = np.sort(passage)
    return int(np.minimum(times, np.searchsorted(ordered, distinct, "right") - np.searchsorted(ordered, distinct)).sum())


def seeds_of(items: DataFrame) -> DataFrame:
    """key, n_words and each distinct seed of the items; an item shorter than a seed is one seed of all its words."""

    def cut(batches):
        for batch in batches:
            out = ([], [], [])
            for key, t in zip(batch.column(0), batch.column(1), strict=True):
                hashes = words((t.as_py() or "").encode(), MARKS)[0]
                for s in np.unique(shingles(hashes, SEED)).view(np.int64).tolist():
                    for column, v in zip(out, (key.as_py(), len(hashes), s), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "n_words", "seed"])

    return items.select("key", "item").mapInArrow(cut, "key bigint, n_words bigint, seed bigint")


def passages(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """doc_id, digest of the whole text, text and seeds of every passage that may hold a seed, with as many words around it as the longest item has.

    Whole texts are scanned against a filter of fixed size; hits nearer than that many words share a passage.
    """

    def cells(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_cells(batch.column(0).to_numpy().view(np.uint64)))))], ["cell"])

    filter_ = np.zeros(FILTER_BITS, bool)
    used = seeds.select("seed").mapInArrow(cells, "cell bigint").distinct().toArrow()["cell"].to_numpy()  # FILTER_BITS at most
    filter_[used] = True
    facts = seeds.groupBy(F.least("n_words", F.lit(SEED)).alias("size")).agg(F.max("n_words").alias("longest")).collect()  # SEED rows at most
    sizes, margin = [r["size"] for r in facts], max((r.longest for r in facts), default=0)
    known = docs.sparkSession.sparkContext.broadcast(np.packbits(filter_))

    def scan(batches):
        open_ = np.unpackbits(known.value).astype(bool)
        for batch in batches:
            out = ([], [], [], [])
            for doc, digest, t in zip(*batch.columns, strict=True):
                data = (t.as_py() or "").encode()
                hashes, starts, ends = words(data, MARKS)
                at, found = [], []
                for size in sizes:
                    if len(hashes) >= size:
                        every = shingles(hashes, size)
                        one, two = _cells(every)
                        hit = np.flatnonzero(open_[one])
                        hit = hit[open_[two[hit]]]
                        at.append(hit)
                        found.append(every[hit])
                if not at or not sum(map(len, at)):
                    continue
                at, found = np.concatenate(at), np.concatenate(found)
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > margin) + 1):
                    first, last = max(0, at[part[0]] - margin), min(len(hashes), at[part[-1]] + SEED + margin) - 1
                    for column, v in zip(out, (doc.as_py(), digest.as_py(), data[starts[first] : ends[last]].decode(), np.unique(found[part]).view(np.int64)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int64()))], ["doc_id", "digest", "text", "seeds"])

    rows = docs.select(F.col("doc_id").cast("bigint"), _digest().alias("digest"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "doc_id bigint, digest binary, text string, seeds array<bigint>")


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _copies(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """doc_id and digest of a document's text, item_id, score, words and seeds of every passage that counts as a copy.

    Every seed of every item makes candidates, common or not; a pair is left unaligned only where the
    words in common are too few for any alignment to count.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontamination")
    items = benchmark.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("item")).distinct()
    items = work.keep(items.withColumn("key", F.monotonically_increasing_id()), "items")  # ids can be null or repeated
    seeds = work.keep(seeds_of(items), "seeds")
    found = work.keep(passages(docs, seeds).withColumn("passage", F.monotonically_increasing_id()), "passages")
    hits = work.keep(found.select("passage", F.explode("seeds").alias("seed")), "hits")
    pairs = work.keep(hits.join(seeds.select("key", "seed"), "seed").groupBy("passage", "key").agg(F.count(F.lit(1)).alias("seeds")), "pairs")

    def score(batches):
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for item, text in zip(batch.column(4), batch.column(5), strict=True):
                item = item.as_py()
                if item not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[item] = words(item.encode(), MARKS)[0]
                passage, n = words(text.as_py().encode(), MARKS)[0], max(1, len(seen[item]))
                enough = lambda score: score / n >= threshold and score >= min(LEAST, n)  # noqa: B023, E731
                best = align(seen[item], passage)[0] if enough(reach(seen[item], passage)) else 0.0
                out.append((best, best / n, enough(best)))
            value, share, keep = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
            rows = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(value, pa.float64()), pa.array(share, pa.float64())], ["doc_id", "digest", "item_id", "seeds", "words", "score"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    both = pairs.join(items, "key").join(found.select("passage", "doc_id", "digest", "text"), "passage")
    return both.select("doc_id", "digest", "item_id", "seeds", "item", "text").mapInArrow(score, "doc_id bigint, digest binary, item_id bigint, seeds bigint, words double, score double")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score (share of the item's words that align), words (aligned score) and seeds of every copy found.

    Null texts count as empty and never match; rows and items with null ids are kept; repeated rows and
    repeated items give one row for each pair of ids; empty tables give none; further columns are ignored.
    """
    aligned = _copies(docs, benchmark, threshold)
    return aligned.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("words").alias("words"), F.max("seeds").alias("seeds"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows and columns of the documents whose text has no copy of any item, decided by the text, whatever the id.

    Null texts count as empty and stay; rows with null or shared ids go only if their own text has a copy; repeated
    rows go or stay together; empty tables change nothing; columns of any name pass through.
    """
    key, of = fresh(docs.columns, "key", "of")
    bad = _copies(docs, benchmark, THRESHOLD).select(F.col("digest").alias(of)).distinct()
    return docs.withColumn(key, _digest()).join(bad, F.col(key) == F.col(of), "left_anti").drop(key)
