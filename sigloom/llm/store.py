"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from sigloom.sources.scratch import shared_dir


class Kept:
    """A written table: `df` reads it, `drop` deletes its files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps now, not when the driver's
    memory happens to be collected: they go with the plans that made them. The
    first round frees what Python held, the second the plans behind it."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for plain scans, the bytes of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, per_partition: int = 16 << 20) -> int:
    """Shuffle partitions for work that grows with the input: at least the
    session's own number, and more where partitions would exceed the size."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    # In-memory rows have no estimate; Spark then reports a huge number.
    return conf if size >= 1 << 60 else max(conf, -(-size // per_partition))


def files_for(df: DataFrame, per_file: int = 4 << 20) -> int:
    """Files for a result that is no larger than df, at most its shuffle partitions.
    Each file costs a task, and on a local file system processes that Hadoop starts
    to set its permissions."""
    return min(max(1, -(-input_bytes(df) // per_file)), partitions_for(df))
