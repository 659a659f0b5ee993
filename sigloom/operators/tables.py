"""Operators on whole tables: parity checks, merges, as-of joins, densifying."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.operators.names import by_place, fresh, same
from sigloom.operators.slices import with_carry


def merge_signals(frames: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Full outer merge of (keys, value) tables: one column for each name. Null
    keys equal each other."""
    own = [f"_k{i}" for i in range(len(keys))]
    named = [df.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.col(value).alias(f"_v{n}")) for n, df in enumerate(frames.values())]

    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.toDF(*(f"{c}_" if c in own else c for c in b.columns))
        both = a.join(b, same([a[o] for o in own], [b[f"{o}_"] for o in own]), "full_outer")
        rest = [c for c in [*a.columns, *b.columns] if c.startswith("_v")]
        # A row that only one side has keeps that side's keys, null or not.
        return both.select(*(F.coalesce(F.col(o), F.col(f"{o}_")).alias(o) for o in own), *rest)

    return reduce(merged, named).toDF(*keys, *frames)


def parity(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Keyed differences of two tables with the same columns: the keys and
    'missing_left', 'missing_right', or the first column that differs. Numbers
    differ beyond the tolerance; null equals null only, in keys too. Repeated keys
    are numbered in the order of their other columns, so a repeat on one side
    shows. Columns of any name are compared: inside, they go by their places."""
    cols = [*keys, *(c for c in left.columns if c not in keys)]
    n_keys, n = len(keys), len(cols)
    a, b = by_place(left.select(*cols), "l"), by_place(right.select(*cols), "r")

    def numbered(df: DataFrame, side: str) -> DataFrame:
        names = df.columns
        w = Window.partitionBy(*names[:n_keys]).orderBy(*(names[n_keys:] or names))
        return df.withColumn(f"{side}_copy", F.row_number().over(w)).withColumn(f"{side}_in", F.lit(True))

    on = same([F.col(f"l{k}") for k in range(n_keys)] + [F.col("l_copy")], [F.col(f"r{k}") for k in range(n_keys)] + [F.col("r_copy")])
    both = numbered(a, "l").join(numbered(b, "r"), on, "full_outer")
    found = F.when(F.col("l_in").isNull(), "missing_left").when(F.col("r_in").isNull(), "missing_right")
    for k in range(n_keys, n):
        x, y = F.col(f"l{k}"), F.col(f"r{k}")
        equal = x.eqNullSafe(y)
        if tolerance and isinstance(left.schema[cols[k]].dataType, T.NumericType):
            equal = equal | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        found = found.when(~equal, cols[k])
    copy, difference = fresh(keys, "copy"), fresh(keys, "difference")
    out = [F.coalesce(f"l{k}", f"r{k}").alias(c) for k, c in enumerate(keys)]
    return both.select(*out, F.coalesce("l_copy", "r_copy").alias(copy), found.alias(difference)).filter(F.col(difference).isNotNull())


def multiset_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with `side`; repeats
    count. Both ways of EXCEPT ALL."""
    right = right.select(*left.columns)
    side = fresh(left.columns, "side")
    return left.exceptAll(right).withColumn(side, F.lit("left")).union(right.exceptAll(left).withColumn(side, F.lit("right")))


def parity_report(pairs: dict[str, tuple[DataFrame, DataFrame, list[str]]], tolerance: float = 0.0) -> DataFrame:
    """(table, differences, verdict) with PASS or FAIL for each pair of tables."""
    rows = [parity(a, b, k, tolerance).agg(F.count("*").alias("differences")).select(F.lit(n).alias("table"), "differences") for n, (a, b, k) in pairs.items()]
    return reduce(DataFrame.union, rows).withColumn("verdict", F.when(F.col("differences") == 0, "PASS").otherwise("FAIL"))


def daily_parity(left: DataFrame, right: DataFrame, keys: list[str], day: str) -> DataFrame:
    """(day, differences) of every day on either side."""
    days = left.select(day).union(right.select(day)).distinct()
    found = parity(left, right, keys).groupBy(day).agg(F.count("*").alias("n"))
    return days.join(found, day, "left").select(day, F.coalesce("n", F.lit(0)).alias("differences"))


def as_of(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, values: list[str], seconds: int = 30 * 86400) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before
    its time. The two sides are stacked, and the last right row seen is carried
    on, so no pair of rows is ever made. A key is cut into time slices of `seconds`
    (each slice's last right row is carried to the next ones), so a hot key is not
    one task's. Of right rows at one time the largest values win; left rows of a
    null key or time have none."""
    keep = list(left.columns)
    pack = F.struct(*(F.col(v) for v in values))
    kind = right.select(pack.alias("v")).schema["v"].dataType
    row = left.select(F.struct(*keep).alias("r")).schema["r"].dataType
    a = left.select(F.col(by).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*keep).alias("_row"), F.lit(None).cast(kind).alias("_v"))
    b = right.select(F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(row).alias("_row"), pack.alias("_v"))
    b = b.filter("_by IS NOT NULL AND _ts IS NOT NULL")
    numeric = isinstance(left.schema[left_ts].dataType, T.NumericType)
    stacked = a.union(b)
    stacked = stacked.withColumn("_at", F.timestamp_seconds("_ts")) if numeric else stacked.withColumn("_at", F.col("_ts"))
    last = F.max(F.when(F.col("_side") == 0, F.struct("_ts", "_v")))
    cut = with_carry(stacked, "_by", "_at", seconds, last, lambda c: F.last(c, ignorenulls=True), "_slice", "_carry")
    w = Window.partitionBy("_by", "_slice").orderBy("_ts", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    here = F.last(F.when(F.col("_side") == 0, F.struct("_ts", "_v")), ignorenulls=True).over(w)
    seen = cut.withColumn("_seen", F.coalesce(here, F.col("_carry"))).filter("_side = 1")
    return seen.select("_row.*", *(F.col(f"_seen._v.{v}").alias(f"asof_{v}") for v in values))


def densify(panel: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Every key on every day from the first to the last of the table; value is
    carried forward."""
    lo, hi = panel.agg(F.min(day), F.max(day)).first()
    days = F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"), F.expr("interval 1 day"))
    grid = panel.select(key).distinct().withColumn(day, F.explode(days))
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(panel, [key, day], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def top_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)
