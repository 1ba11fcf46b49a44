"""Shared helpers: the cluster's shared folder, intermediate tables and table readers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reach(spark: SparkSession) -> None:
    """Lets Python workers import this package when the repository is not installed (one path on every machine), in small batches."""
    root, paths = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, paths)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # texts can be long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="revlake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Workspace:
    """Intermediate Parquet tables under the shared folder.

    A written table cuts lineage, survives the loss of any executor (Spark's commit protocol
    publishes whole task outputs only) and is compressed, unlike checkpoint files. Tables that a lazy
    result still reads are deleted when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(root)
        self.spark._jvm.System.gc()  # lets Spark delete the shuffle files of the finished step
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """As keep, and deletes all other tables."""
        kept = self.keep(df, name)
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            if status.getPath().getName() != name:
                fs.delete(status.getPath(), True)
        return kept

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; null ids fall in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is among those taken (case does not count): columns that a step adds for itself."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
