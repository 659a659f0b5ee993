"""Connected components of an edge table by alternating star contraction.

Both star steps are a grouped minimum (pre-aggregated map-side) and a join back
on the node, which adaptive execution may split for hubs. Each round is written
to the shared folder, so a lost executor costs one round at most, in as many files
as its size asks for: no star step adds edges. Nothing is collected but two numbers
a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.store import Kept, files_for


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame, max_rounds: int = 50) -> Kept:
    """(u, v): every node but the smallest of its component, with that smallest.

    edges: two columns of one orderable type, in any order and direction; loops
    and repeats are ignored, and so are rows with a null. An empty table gives an empty one. The caller drops
    the result's files when it is done with them.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    now = Kept(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().coalesce(files_for(edges)), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now
        seen, before = mark, now
        now = Kept(_small_star(_large_star(before.df)).coalesce(files_for(before.df)), "edges")
        before.drop()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
