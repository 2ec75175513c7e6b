"""Checkpoints in the folder the cluster names, and loops over DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="weftgraph-checkpoint-")
    sc.setCheckpointDir(configured)


#: Rows of ids that are broadcast at most.
FEW = 200_000


def few(df: DataFrame, n: int) -> DataFrame:
    """df, broadcast in a join if its n rows, which were counted, are few."""
    return F.broadcast(df) if n <= FEW else df


def unguessed(df: DataFrame) -> DataFrame:
    """df in a join that sorts and merges. Spark guesses sizes from the files that were read; rows that text and lists
    grew into can be a hundred times that, and a broadcast of them is the driver's memory."""
    return df.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """The rows on shared storage, without their lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
