"""Session setup."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it is not installed, and sets a checkpoint folder where none is set."""
    root, paths = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, paths)))
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one set in the context. A temporary one is set only where there is none
    and all of Spark is in this process: other machines could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="revlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")
