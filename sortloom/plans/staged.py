"""Data written on the way, where a plan needs the same rows twice and in the same places."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, or one under /tmp where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        path = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        root = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its partitions and their order kept: a lost executor
    loses nothing, and no stage below runs again."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()
