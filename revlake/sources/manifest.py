"""Manifests: which files make up a version of a store, with their statistics."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.errors import CorruptionError
from revlake.operators.compact import Segment
from revlake.operators.ranges import KeyRange
from revlake.plans.schema import LOG

FORMAT = 2


@dataclass(frozen=True)
class Manifest:
    """applied_index is the position in the command log, applied_through the greatest visible revision: a failed
    transaction moves only the first, and a restore may move both back. Below retained_from, compaction has dropped
    versions."""

    version: int = 0
    applied_index: int = 0
    applied_through: int = 0
    next_order: int = 0
    segments: tuple[Segment, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    retained_from: int = 0

    def next(self, **changes) -> Manifest:
        return replace(self, version=self.version + 1, **changes)

    def to_json(self) -> str:
        body = {
            "format": FORMAT,
            "version": self.version,
            "applied_index": self.applied_index,
            "applied_through": self.applied_through,
            "next_order": self.next_order,
            "batches": self.batches,
            "retained_from": self.retained_from,
            "segments": [{**s.__dict__, "low": s.low.hex(), "high": s.high.hex()} for s in self.segments],
        }
        text = json.dumps(body, sort_keys=True)
        return json.dumps({"sha256": hashlib.sha256(text.encode()).hexdigest(), "manifest": body}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            whole = json.loads(text)
            body = whole["manifest"]
            if whole["sha256"] != hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest():
                raise CorruptionError("the manifest does not match its digest")
            if body["format"] != FORMAT:
                raise CorruptionError(f"unknown manifest format {body['format']}")
            segments = tuple(Segment(**{**s, "low": bytes.fromhex(s["low"]), "high": bytes.fromhex(s["high"])}) for s in body["segments"])
            return cls(body["version"], body["applied_index"], body["applied_through"], body["next_order"], segments, body["batches"], body["retained_from"])
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptionError(f"the manifest cannot be read: {e}") from None

    def pick(self, keys: KeyRange = KeyRange(), at: int | None = None) -> list[Segment]:
        """The segments that can hold an entry of the range at or below the revision."""
        return [s for s in self.segments if keys.overlaps(s.low, s.high) and (at is None or s.min_revision <= at)]

    def pick_keys(self, keys: list[bytes], at: int | None = None) -> list[Segment]:
        """The segments in whose key range one of the keys lies, and that hold an entry at or below the revision."""
        ordered = sorted(keys)
        meets = lambda s: (i := bisect_left(ordered, s.low)) < len(ordered) and ordered[i] <= s.high
        return [s for s in self.segments if meets(s) and (at is None or s.min_revision <= at)]


def read_segments(spark: SparkSession, root: str, segments: list[Segment]) -> DataFrame:
    """The entries of the segments, by an explicit file list and the fixed schema (nothing is inferred or listed)."""
    if not segments:
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).parquet(*(f"{root}/{s.path}" for s in segments))


def measure(spark: SparkSession, root: str, folder: str, level: int, order: int) -> tuple[Segment, ...]:
    """One row of statistics for each file of a written folder: what reaches the driver grows with the files only.

    The fingerprint is an order-free sum over the entries' hashes.
    """
    rows = spark.read.schema(LOG).parquet(f"{root}/{folder}").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"))
    found = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("size").alias("size"),
        F.min("key").alias("low"),
        F.max("key").alias("high"),
        F.min("revision").alias("first"),
        F.max("revision").alias("last"),
        F.sum(F.xxhash64("key", "revision", "deleted", "value").cast("decimal(20,0)")).alias("sum"),
    )
    return tuple(Segment(f"{folder}/{r.file}", level, r.rows, r["size"], bytes(r.low), bytes(r.high), r["first"], r["last"], str(r["sum"]), order) for r in found.orderBy("file").collect())


def write_segment(log: DataFrame, root: str, folder: str, files: int = 1, compression: str = "zstd", bloom: bool = True) -> None:
    """Range-partitions by key, so that no key is split between files, and sorts by key and falling revision."""
    ordered = log.select(*LOG.fieldNames()).repartitionByRange(files, "key").sortWithinPartitions("key", F.col("revision").desc())
    out = ordered.write.option("compression", compression)
    if bloom:
        out = out.option("parquet.bloom.filter.enabled#key", "true")
    out.parquet(f"{root}/{folder}")
