"""Keeping an operator's own columns apart from those of its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have (Spark ignores case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def sealed(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The table with its columns renamed by position (in0, in1, ...), and the
    expressions that select them back under their own names."""
    names = [f"in{k}" for k in range(len(df.columns))]
    return df.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, df.columns)]
