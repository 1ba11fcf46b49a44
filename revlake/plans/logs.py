"""Logs over the test tables, and the queries' shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.functions.keys import text, utf8

EVENTS_SQL = """
SELECT concat('user/', lpad(CAST(user_id AS STRING), 8, '0')) AS k, event_id + 1 AS revision, event_type = 'error' AS deleted,
       CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, '|', CAST(CAST(round(value * 100) AS BIGINT) AS STRING)) END AS v
FROM {events}
"""
ORDERS_SQL = """
SELECT concat('cust/', lpad(CAST(o_custkey AS STRING), 8, '0')) AS k, o_orderkey + 1 AS revision, o_orderstatus = 'F' AS deleted,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS v
FROM {orders}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(sql, **tables).select(utf8("k").alias("key"), F.col("revision").cast("bigint").alias("revision"), "deleted", utf8("v").alias("value"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per event: many versions of few users' keys, errors as deletions."""
    return _log(spark, EVENTS_SQL, events=table(spark, sf_dir, "events"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per order: about ten versions of each customer's key."""
    return _log(spark, ORDERS_SQL, orders=table(spark, sf_dir, "orders"))


def shown(rows: DataFrame) -> DataFrame:
    """Keys and values as text, for comparison: k, v and the other columns."""
    return rows.select(*(text(c).alias({"key": "k", "value": "v"}[c]) if c in ("key", "value") else F.col(c) for c in rows.columns))


def top_revision(log: DataFrame) -> int:
    return log.agg(F.max("revision")).first()[0] or 0
