"""Near-duplicates: consistent weighted sampling over TF-IDF shingles, banding, weighted Jaccard verification."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.clusters import classes
from revlake.llm.common import Workspace, fresh
from revlake.llm.hashing import mix, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
#: Samples are BANDS times ROWS; at a similarity of 0.8 a pair shares a band with probability 0.995, at 0.9 0.99997.
BANDS, ROWS = 10, 4
#: A leader's text is sent once for this many of the texts that it is compared with.
FELLOWS = 256
#: Bits of the parity sketch of a text's shingles, as 64-bit words, and rows of a lookup table (about 100 bytes each) that is broadcast.
WORDS, FEW = 32, 500_000
#: Slack of the bounds for sums in another order.
SLACK = 1e-4
#: Document frequencies of words are counted in this many cells, whatever the corpus's size.
CELLS = 1 << 20

_RNG = np.random.default_rng(0x1C35)
_SEEDS = _RNG.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
#: Quantised draws of Gamma(2, 1), its logarithm and of the uniform distribution, indexed by hash bits.
_DRAWS = 1 << 12
_U = (np.arange(_DRAWS) + 0.5) / _DRAWS


def _gamma2() -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by Newton's method."""
    x = np.full(_DRAWS, 1.5)
    for _ in range(80):
        x = np.maximum(1e-6, x - np.clip((1 - (1 + x) * np.exp(-x) - _U) / (x * np.exp(-x) + 1e-12), -1, 1))
    return x


_R = _gamma2().astype(np.float32)
_LOG_C = np.log(_gamma2()).astype(np.float32)
_BETA = _U.astype(np.float32)


def idf_table(docs: DataFrame) -> np.ndarray:
    """Scaled inverse document frequency, 0 to 1, of each cell of hashed words: log((N + 1) / (df + 1)) / log(N + 1).

    Every document counts. Each task sums its own cells; the sums are added up by a shuffle. What reaches
    the driver is one number for each of CELLS cells at most.
    """

    def count(batches):
        cells, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                hashes = words((t.as_py() or "").encode())[0]
                cells[np.unique(hashes & np.uint64(CELLS - 1)).astype(np.int64)] += 1
                n += 1
        at = np.flatnonzero(cells)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(cells[at[i : i + (1 << 16)]])], ["cell", "n"])
        yield pa.RecordBatch.from_pydict({"cell": [-1], "n": [n]})

    counted = docs.select("text").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    at, n = counted["cell"].to_numpy(), counted["n"].to_numpy().astype(np.float64)
    total = n[at < 0].sum()
    df = np.zeros(CELLS)
    df[at[at >= 0]] = n[at >= 0]
    return (np.log((total + 1) / (df + 1)) / np.log(total + 2)).astype(np.float32)


def weigh(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a whole text in order, and their weights: term frequency times 1 + the mean idf of the words."""
    hashes = words((text or "").encode())[0]
    if not len(hashes):
        return hashes, np.zeros(0, np.float32)
    every = shingles(hashes, SHINGLE)
    k = min(SHINGLE, len(hashes))
    total = np.concatenate([[0.0], np.cumsum(idf[(hashes & np.uint64(CELLS - 1)).astype(np.int64)], dtype=np.float64)])
    mean = (total[k:] - total[:-k]) / k
    distinct, first, times = np.unique(every, return_index=True, return_counts=True)
    return distinct, (times * (1 + mean[first])).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of smaller weights over sum of larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1e-12, float(a[1].sum()) + float(b[1].sum()) - both)


def band_keys(hashes: np.ndarray, weights: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """One key per band, of ROWS consistent weighted samples (Ioffe, 2010), and 32 bits of every sample, which estimate similarities; none for a text without words."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    k = len(_SEEDS)
    best, at, level = np.full(k, np.inf, np.float32), np.zeros(k, np.int64), np.zeros(k, np.int64)
    low, log_w = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32), np.log(weights)
    for i in range(0, len(low), block):
        h = low[i : i + block, None] * _SEEDS
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        r = _R[h >> np.uint32(20)]
        h *= np.uint32(0xC2B2AE35)
        log_c = _LOG_C[h >> np.uint32(20)]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x27D4EB2F)
        beta = _BETA[h >> np.uint32(20)]
        t = np.floor(log_w[i : i + block, None] / r + beta)
        log_a = log_c - r * (t - beta + 1)
        row = log_a.argmin(0)
        low_a = log_a[row, np.arange(k)]
        better = low_a < best
        best[better], at[better], level[better] = low_a[better], row[better] + i, t[row, np.arange(k)][better].astype(np.int64)
    sample = mix(hashes[at] + mix(level.astype(np.uint64)))
    sketch = (sample & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    sample = sample.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(31) + sample[:, j])
    return key.view(np.int64), sketch


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """doc_id and class_id of every row, and the row that stays of every class (digest, doc_id).

    Equal texts share a class; so do texts that a chain of verified pairs joins. class_id is the
    smallest doc_id of the class. Null texts count as empty; texts without words join only their
    exact copies; rows with null ids take part and stay only if their class has no other id; repeated
    rows each give a row; an empty table gives none; further columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    idf = spark.sparkContext.broadcast(idf_table(docs))  # CELLS numbers

    def sign(batches):
        for batch in batches:
            weighed = [weigh(t.as_py(), idf.value) for t in batch.column(2)]
            bands, total = [band_keys(*x)[0] for x in weighed], [float(w.sum(dtype=np.float64)) for _, w in weighed]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bands, pa.list_(pa.int64())), pa.array(total, pa.float64())], ["doc_id", "digest", "keys", "total"])

    signed = docs.select("doc_id", digest.alias("digest"), "text").mapInArrow(sign, "doc_id bigint, digest binary, keys array<bigint>, total double")
    signed = work.keep(signed, "signed")
    nodes = signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys"), F.first("total").alias("total"))
    nodes = work.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    texts = _candidates(work, docs.withColumn("digest", digest), nodes, members)
    facts = work.keep(nodes.select("node", "total", "keys").join(alone(texts, idf), "node"), "facts")
    hopeful = facts.where(F.col("alone") <= (1 - threshold) * F.col("total") + SLACK * F.col("total"))
    members = work.keep(members.join(hopeful.select("node"), "node").select("bucket", "node"), "members")

    def bound(other: str) -> Column:
        """False only below the threshold: by the weight that each has alone, and by shingles that only one of the two has."""
        both = F.least(F.col("total") - F.col("alone"), F.col(f"{other}total") - F.col(f"{other}alone"))
        whole = F.col("total") + F.col(f"{other}total")
        apart = sum((F.bit_count(F.col(f"k{w}").bitwiseXOR(F.col(f"{other}k{w}"))) for w in range(WORDS)), F.lit(0)) * F.least("lightest", F.col(f"{other}lightest"))
        return (both >= (threshold - SLACK) * (whole - both)) & (apart * (1 + threshold) <= whole * (1 - threshold) * (1 + SLACK))

    def possible(leader: str) -> Column:
        """bound, and that this is the first of the buckets that the two share."""
        at = F.array_position(F.zip_with("keys", f"{leader}keys", lambda x, y: x == y), F.lit(True)).cast("int")
        return bound(leader) & (F.col("bucket") == F.xxhash64(at - 1, F.element_at("keys", at)))

    measures = ["total", "alone", "lightest", *(f"k{w}" for w in range(WORDS))]

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda s, prefix: facts.select(F.col("node").alias(s), *(F.col(c).alias(f"{prefix}{c}") for c in measures))
        pairs = work.keep(pairs.join(side("b", ""), "b").join(side("a", "lead_"), "a").where(bound("lead_")).select("a", "b"), f"near-{next(rounds)}")
        crowds = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FELLOWS).cast("int").alias("seats"))
        seated = pairs.join(crowds, "a").withColumn("seat", F.pmod(F.xxhash64("b"), F.col("seats")).cast("int"))
        text_a = texts.join(crowds, F.expr("node = a")).select("a", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)).alias("seat"), F.col("text").alias("text_a"))
        text_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

        def compare(batches):
            last, seen = None, None
            for batch in batches:
                close = []
                for a, b in zip(batch.column(2), batch.column(3), strict=True):
                    a = a.as_py()
                    if a != last:
                        last, seen = a, weigh(a, idf.value)
                    close.append(similarity(seen, weigh(b.as_py(), idf.value)) >= threshold)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(close, pa.bool_()))

        both = seated.join(text_b, "b").join(text_a, ["a", "seat"])
        return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint")

    rounds = count()
    labels = classes(work, members, verify, facts=facts, possible=possible)
    rooted = work.keep(nodes.join(labels, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root")), "rooted")
    order = F.coalesce("first", F.lit(2**63 - 1))
    heads = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.min_by("digest", F.struct(order, F.col("digest"))).alias("digest"))
    heads = work.keep(heads, "heads")
    by_text = work.keep(rooted.join(heads.select("root", "class_id"), "root").select("digest", "class_id"), "by-text")
    rows = signed.select("doc_id", "digest").join(by_text, "digest").select("doc_id", "class_id")
    return rows, heads.select("digest", F.col("class_id").alias("doc_id"))


def _candidates(work: Workspace, docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node and text of every distinct text that shares a bucket with another one."""
    shared = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket")
    used = members.join(shared, "bucket").select("node").distinct()
    used = work.keep(nodes.join(used, "node").select("node", F.col("digest").alias("d"), "first"), "used")
    few = used.count() <= FEW  # then texts are found where they are read, else by a shuffle
    texts = docs.join(F.broadcast(used) if few else used, F.expr("digest = d AND doc_id <=> first")).select("node", "text")
    return work.keep(texts.dropDuplicates(["node"]), "texts")


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bit i says whether an odd number of the hashes falls in cell i of 64 * WORDS.

    Two sets' sketches differ in at most as many bits as there are members of only one of them.
    """
    cells = np.bincount((hashes % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view(np.int64)


def alone(texts: DataFrame, idf: Broadcast) -> DataFrame:
    """node, alone (the weight of the shingles that no other candidate has), the lightest weight, and the parity sketch of every candidate.

    A text of which more than 1 - threshold is alone is similar to none: heavily edited copies and texts with a common
    passage are told apart by one count of the candidates' shingles, however many share a bucket.
    """

    def weights(batches):
        for batch in batches:
            for node, t in zip(*batch.columns, strict=True):
                hashes, weight = weigh(t.as_py(), idf.value)
                columns = [pa.array(np.full(len(hashes), node.as_py(), np.int64)), pa.array(hashes.view(np.int64)), pa.array(weight.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingle", "weight"])

    def sketches(batches):
        for batch in batches:
            weighed = [weigh(t.as_py(), idf.value) for t in batch.column(1)]
            bits = np.array([parity(h) for h, _ in weighed], np.int64).reshape(-1, WORDS)
            lightest = pa.array([float(w.min(initial=np.inf)) for _, w in weighed], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lightest, *(pa.array(np.ascontiguousarray(bits[:, w])) for w in range(WORDS))], ["node", "lightest", *(f"k{w}" for w in range(WORDS))])

    every = texts.mapInArrow(weights, "node bigint, shingle bigint, weight double")
    once = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
    found = once.groupBy("node").agg(F.sum("weight").alias("alone"))
    known = texts.mapInArrow(sketches, f"node bigint, lightest double, {', '.join(f'k{w} bigint' for w in range(WORDS))}")
    return known.join(found, "node", "left").select(*known.columns, F.coalesce("alone", F.lit(0.0)).alias("alone"))


def dedupe(docs: DataFrame) -> DataFrame:
    """The documents' rows and columns, one row of each class: that with the smallest doc_id (null last), any one of equal ids and texts.

    Null and empty texts are one class; rows with null ids stay only if their class has no other id; repeated rows give
    one row; an empty table gives none; columns of any name pass through.
    """
    _, stays = groups(docs)
    key, of, first = fresh(docs.columns, "digest", "of", "first")
    stays = stays.select(F.col("digest").alias(of), F.col("doc_id").alias(first))
    rows = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    rows = rows.join(stays, (F.col(key) == F.col(of)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(first)), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).drop(key)
