"""Reading the standard tables and writing results to one agreed place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigloom.operators.layouts import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Spark's own reader, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def result_path(out_dir: str, run_id: str, name: str) -> str:
    """Where a run's table lives. Writers and readers both ask here."""
    return f"{out_dir.rstrip('/')}/{run_id}/tables/{name}"


def write_result(df: DataFrame, out_dir: str, run_id: str, name: str, schema: StructType | None = None) -> str:
    """Write a result once; an existing run directory is never overwritten. With a
    schema the table is checked against it and has its columns only."""
    path = result_path(out_dir, run_id, name)
    (df if schema is None else conform(df, schema)).write.mode("errorifexists").parquet(path)
    return path


def read_result(spark: SparkSession, out_dir: str, run_id: str, name: str) -> DataFrame:
    """Read back what write_result wrote."""
    return spark.read.parquet(result_path(out_dir, run_id, name))


def table_as_of(spark: SparkSession, sf_dir: str, name: str, ts: str, last_day: str) -> DataFrame:
    """Rows up to and including a day; the bound is pushed down to the scan."""
    return table(spark, sf_dir, name).filter(F.col(ts) < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp_ntz"))
