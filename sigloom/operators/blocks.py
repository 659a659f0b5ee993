"""Nested-loop joins over blocks of rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.names import by_place

#: Rows of a block, as a power of two.
BITS = 8


def _packed(df: DataFrame, key: str, side: str) -> DataFrame:
    """(lo, hi, rows): blocks of neighbours by key. Ranges also cut by the other
    columns, so a hot key is not one task's and fills many blocks."""
    names, k = [f"{side}{n}" for n in range(len(df.columns))], f"{side}{df.columns.index(key)}"
    order = [k, *(n for n in names if n != k)]
    rows = by_place(df, side).filter(F.col(k).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = rows.groupBy(F.shiftright(F.monotonically_increasing_id(), BITS).alias("block"))
    return blocks.agg(F.min(k).alias(f"{side}_lo"), F.max(k).alias(f"{side}_hi"), F.collect_list(F.struct(*names)).alias(f"{side}_rows"))


def replicate_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join by a shuffled and replicated nested loop, with the columns
    of both sides. The loop over the whole of both sides meets blocks, not rows;
    only blocks whose keys overlap are opened, and a second loop compares their
    rows. Columns must have an order; null keys equal nothing. The loop has a task
    for each pair of partitions, so both sides get few: four tasks for each core."""
    n = math.ceil(math.sqrt(4 * left.sparkSession.sparkContext.defaultParallelism))
    a, b = (_packed(*side).drop("block").coalesce(n) for side in ((left, left_key, "l"), (right, right_key, "r")))
    met = a.join(b.hint("shuffle_replicate_nl"), (F.col("l_lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("l_hi")))
    opened = met.select(F.explode("l_rows").alias("l"), "r_rows").select("l", F.explode("r_rows").alias("r"))
    equal = opened.filter(F.col(f"l.l{left.columns.index(left_key)}") == F.col(f"r.r{right.columns.index(right_key)}"))
    return equal.select("l.*", "r.*").toDF(*left.columns, *right.columns)
