"""Sources and sinks other than Parquet, through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What each format needs besides a schema; CSV tells empty text from null by quotes.
OPTIONS = {
    "csv": {"header": "true", "nullValue": "\\N", "emptyValue": "", "escape": '"', "multiLine": "true"},
    "json": {},
    "orc": {},
    "parquet": {},
    "xml": {"rowTag": "row", "rootTag": "rows", "nullValue": "\\N"},
}


def write_format(df: DataFrame, path: str, fmt: str) -> str:
    """Write a table once; returns its path."""
    _known(fmt)
    df.write.mode("errorifexists").format(fmt).options(**OPTIONS[fmt]).save(path)
    return path


def read_format(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Read with a declared schema: nothing is inferred, so no extra scan."""
    _known(fmt)
    return spark.read.format(fmt).schema(schema).options(**OPTIONS[fmt]).load(path)


def _known(fmt: str) -> None:
    if fmt not in OPTIONS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(sorted(OPTIONS))}")


def write_lines(df: DataFrame, path: str) -> str:
    """Write a table's one string column as lines of text."""
    df.write.mode("errorifexists").text(path)
    return path


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def write_jdbc(df: DataFrame, url: str, name: str, driver: str) -> None:
    df.write.format("jdbc").mode("errorifexists").options(url=url, dbtable=name, driver=driver).save()


def read_jdbc(spark: SparkSession, url: str, name: str, driver: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
    """A table of a database. With a numeric column and its range the read is cut
    into `parts` queries (rows outside the range fall to the first and last)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, driver=driver)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
