"""Ordered windows over long keys, cut into slices.

A window function sorts all rows of a key in one task. Here the time axis is cut
into slices; a slice is summed up, the sums are carried along the key (one row a
slice), and the rows of a slice need only their own slice and what was carried
in. Results equal those of the plain window function; a null time comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.operators.names import fresh, same


def slice_of(ts: str, seconds: int) -> Column:
    """The number of the slice that a time falls into."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)
    return F.coalesce(F.floor(at).cast("long"), F.lit(-(1 << 62)))


def with_carry(df: DataFrame, key: str, ts: str, seconds: int, total: Column, carry, slice_name: str, carry_name: str) -> DataFrame:
    """Rows with their slice and what the key's earlier slices carry in: `total`
    sums up a slice, `carry` maps the column of sums to a function for a window."""
    s = df.withColumn(slice_name, slice_of(ts, seconds))
    sums = s.groupBy(F.col(key).alias("_k"), F.col(slice_name).alias("_s")).agg(total.alias("_sum"))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_k", "_s", carry(F.col("_sum")).over(before).alias(carry_name))
    return s.join(sums, same([F.col(key), F.col(slice_name)], [F.col("_k"), F.col("_s")])).drop("_k", "_s")


def running_max(df: DataFrame, key: str, ts: str, order: list[str], value: str, out: str, seconds: int) -> DataFrame:
    """Adds the largest value of the key so far; `order` (ts first) orders its rows."""
    sl, ca = fresh(df.columns, "slice"), fresh(df.columns, "carry")
    cut = with_carry(df, key, ts, seconds, F.max(value), F.max, sl, ca)
    w = Window.partitionBy(key, sl).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn(out, F.greatest(F.max(value).over(w), F.col(ca))).drop(sl, ca)


def numbered(df: DataFrame, key: str, ts: str, order: list[str], out: str, seconds: int) -> DataFrame:
    """Adds each row's number within its key, from 0."""
    sl, ca = fresh(df.columns, "slice"), fresh(df.columns, "carry")
    cut = with_carry(df, key, ts, seconds, F.count(F.lit(1)), F.sum, sl, ca)
    w = Window.partitionBy(key, sl).orderBy(*order)
    return cut.withColumn(out, F.coalesce(F.col(ca), F.lit(0)) + F.row_number().over(w) - 1).drop(sl, ca)


def rolling_rows(df: DataFrame, key: str, ts: str, order: list[str], rows: int, function: Column, out: str, seconds: int, chunk: int = 100_000) -> DataFrame:
    """Adds a function over the row and the rows - 1 before it. Rows are numbered
    and cut into chunks; the last ones of a chunk are also given to the next."""
    chunk = max(chunk, rows)
    no, ch, own = (fresh(df.columns, n) for n in ("row_no", "chunk", "own"))
    n = numbered(df, key, ts, order, no, seconds)
    at = F.floor(F.col(no) / chunk)
    both = F.when(F.col(no) % chunk > chunk - rows, F.array(at, at + 1)).otherwise(F.array(at))
    dealt = n.withColumn(ch, F.explode(both)).withColumn(own, F.col(ch) == at)
    w = Window.partitionBy(key, ch).orderBy(no).rowsBetween(1 - rows, 0)
    return dealt.withColumn(out, function.over(w)).filter(own).drop(no, ch, own)
