"""Reads: the latest entry per key at a revision, and the point, multi and range forms over it.

Key and revision predicates go below the reduction (they commute with it, or define the snapshot);
the deletion filter, limits and any predicate on values stay above it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.functions.keys import as_bytes
from revlake.operators.ranges import KeyRange


def _bounded(log: DataFrame, at: int | None, keys: KeyRange | None) -> DataFrame:
    if at is not None:
        log = log.where(F.col("revision") <= F.lit(at))
    return log.where(keys.predicate()) if keys is not None and keys != KeyRange() else log


def latest_entries(log: DataFrame, at: int | None = None, keys: KeyRange | None = None) -> DataFrame:
    """The entry with the greatest revision per key, deletions included.

    Ranking plans as a group limit before and after the shuffle, so of a key with many versions each
    task sends one row only, and one hot key cannot fill a task.
    """
    order = Window.partitionBy("key").orderBy(F.col("revision").desc())
    ranked = _bounded(log, at, keys).withColumn("_rank", F.row_number().over(order))
    return ranked.where("_rank = 1").select("key", "revision", "deleted", "value")


def latest_by_aggregate(log: DataFrame, at: int | None = None, keys: KeyRange | None = None) -> DataFrame:
    """The same by max_by (a sort aggregate); kept for the benchmark's comparison."""
    best = _bounded(log, at, keys).groupBy("key").agg(F.max_by(F.struct("revision", "deleted", "value"), "revision").alias("e"))
    return best.select("key", "e.revision", "e.deleted", "e.value")


def latest_by_join(log: DataFrame, at: int | None = None, keys: KeyRange | None = None) -> DataFrame:
    """The same by a hash aggregate and a semi-join on (key, revision); kept for the benchmark's comparison."""
    rows = _bounded(log, at, keys)
    top = rows.groupBy("key").agg(F.max("revision").alias("revision"))
    return rows.join(top, ["key", "revision"], "left_semi").select("key", "revision", "deleted", "value")


def visible(log: DataFrame, at: int | None = None, keys: KeyRange | None = None) -> DataFrame:
    """key, value and revision (of its last change) of every key that exists at the revision."""
    return latest_entries(log, at, keys).where(~F.col("deleted")).select("key", "value", "revision")


def scan(log: DataFrame, keys: KeyRange | None = None, at: int | None = None, limit: int = 0) -> DataFrame:
    """Visible entries in key order; a limit above 0 caps them after visibility, else there is none."""
    out = visible(log, at, keys).orderBy("key")
    return out.limit(limit) if limit > 0 else out


def get(log: DataFrame, key: bytes | str, at: int | None = None) -> DataFrame:
    """One row: key, found, value, revision; an absent or deleted key has found = false."""
    raw = as_bytes(key)
    one = _bounded(log, at, None).where(F.col("key") == F.lit(raw))
    best = one.agg(F.max_by(F.struct("deleted", "value", "revision"), "revision").alias("e"))
    found = F.coalesce(~F.col("e.deleted"), F.lit(False))
    pick = lambda name: F.when(found, F.col(f"e.{name}")).alias(name)
    return best.select(F.lit(raw).alias("key"), found.alias("found"), pick("value"), pick("revision"))


def multi_get(log: DataFrame, keys: DataFrame | Iterable[bytes | str], at: int | None = None) -> DataFrame:
    """One row per distinct requested key, as get() gives it. Keys come as a DataFrame with a key column, or a few literals.

    The log is cut down by a semi-join before the reduction; the planner broadcasts a small key set.
    """
    if not isinstance(keys, DataFrame):
        keys = log.sparkSession.createDataFrame([(as_bytes(k),) for k in keys], "key binary")
    keys = keys.select("key").distinct()
    found = visible(log.join(keys, "key", "left_semi"), at).withColumn("found", F.lit(True))
    return keys.join(found, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value", "revision")


def merge(*sources: DataFrame, partitions: int | None = None) -> DataFrame:
    """All entries of the sources, duplicates kept, range-partitioned by key and sorted by key and falling revision."""
    if not sources:
        raise ValueError("nothing to merge")
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    by = [F.col("key")] if partitions is None else [partitions, F.col("key")]
    return out.repartitionByRange(*by).sortWithinPartitions("key", F.col("revision").desc())
