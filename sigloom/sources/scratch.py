"""The folder for tables that the engine itself writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local master, whose executors are
    the driver, gets a folder of its own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="sigloom-")
    return f"file://{shared_dir.own}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below it that nothing else uses; it isn't made yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
