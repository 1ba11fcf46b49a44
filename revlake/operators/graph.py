"""Connected components of shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(members: DataFrame) -> DataFrame:
    """group and component for rows (group, member): groups that share a member, directly or by a chain, are one component.

    Labels go from groups to members and back until nothing changes, then each to its label's label;
    every round is checkpointed in the folder that the cluster's executors share.
    """
    edges = members.select("group", "member").distinct().checkpoint()
    labels = edges.select("group").distinct().withColumn("component", F.col("group")).checkpoint()
    while True:
        by_member = edges.join(labels, "group").groupBy("member").agg(F.min("component").alias("m"))
        near = edges.join(by_member, "member").groupBy("group").agg(F.min("m").alias("near"))
        jump = labels.select(F.col("group").alias("near"), F.col("component").alias("next"))
        found = labels.join(near, "group").join(jump, "near").select("group", F.least("component", "next").alias("component"), (F.least("component", "next") != F.col("component")).alias("moved")).checkpoint()
        if not found.where("moved").limit(1).count():
            return found.select("group", "component")
        labels = found.select("group", "component")
