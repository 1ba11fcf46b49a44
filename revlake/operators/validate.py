"""Write validation: duplicate keys in a batch, and incoming revisions against the latest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

APPLY, DUPLICATE, STALE, CONFLICT = "apply", "duplicate", "stale", "conflict"


def duplicates(batch: DataFrame, *by: str) -> DataFrame:
    """The keys that a batch (or each of its revisions) holds more than once, with their count n."""
    return batch.groupBy(*(by or ("key",))).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def classify(incoming: DataFrame, latest: DataFrame) -> DataFrame:
    """The incoming entries with cls: a newer revision applies; an equal one is a duplicate if its content is
    equal too and else a conflict; a lower one is stale. Deletions count as latest entries."""
    current = latest.select("key", *(F.col(c).alias(f"_{c}") for c in ("revision", "deleted", "value")))
    same = (F.col("deleted") == F.col("_deleted")) & F.col("value").eqNullSafe(F.col("_value"))
    cls = (
        F.when(F.col("_revision").isNull() | (F.col("revision") > F.col("_revision")), APPLY)
        .when(F.col("revision") < F.col("_revision"), STALE)
        .when(same, DUPLICATE)
        .otherwise(CONFLICT)
    )
    return incoming.join(current, "key", "left").select(*(incoming[c] for c in incoming.columns), cls.alias("cls"))
