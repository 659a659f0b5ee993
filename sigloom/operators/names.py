"""Keeping an operator's own columns apart from those of its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(names: list[str], base: str) -> str:
    """A column name that is not taken (Spark ignores case)."""
    have = {c.lower() for c in names}
    while base.lower() in have:
        base += "_"
    return base


def by_place(df: DataFrame, prefix: str) -> DataFrame:
    """The table with its columns renamed by place: prefix0, prefix1, ..."""
    return df.toDF(*(f"{prefix}{k}" for k in range(len(df.columns))))


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of all pairs; a join still hashes or sorts by it."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out
