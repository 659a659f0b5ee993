"""The nested-loop join over blocks."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F

from sigloom.plans import catalog

QUERY = "join_hint_shuffle_replicate_nl"


def pairs_of_the_loop(spark, df):
    """How many pairs of rows the nested loop of a plan goes through."""

    def find(node):
        if node.nodeName() == "Join":
            return node
        return next((x for k in range(node.children().size()) if (x := find(node.children().apply(k)))), None)

    loop = find(df._jdf.queryExecution().optimizedPlan())
    rows = [spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), side).count() for side in (loop.left(), loop.right())]
    return rows[0] * rows[1]


def test_loop_meets_blocks_not_rows(spark, tmp_path):
    spark.range(3000).selectExpr("id * 50 AS o_orderkey", "id % 2000 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3000).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    df = catalog.queries()[QUERY](spark, str(tmp_path))
    assert pairs_of_the_loop(spark, df) < 3000 * 3000 / 1000
    assert {(r.o_orderkey, r.c_name) for r in df.collect()} == {(k * 50, f"c{k % 2000}") for k in range(3000)}


def test_every_order_is_read(spark, tmp_path):
    spark.range(1, 400).selectExpr("nullif(id, 7) AS o_orderkey", "nullif(id % 60, 3) AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(50).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.queries()[QUERY](spark, str(tmp_path)).collect()
    want = Counter((None if k == 7 else k, f"c{k % 60}") for k in range(1, 400) if k % 60 < 50 and k % 60 != 3)
    assert Counter((r.o_orderkey, r.c_name) for r in got) == want
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert Counter(con.execute(catalog.oracle_sql()[QUERY]).fetchall()) == want


def test_null_hot_and_repeated_keys(spark):
    from sigloom.operators.blocks import replicate_join

    left = spark.range(2000).select(F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 2 = 0 THEN 5 ELSE id - 900 END").alias("k"), F.col("id").alias("v"))
    right = spark.range(1500).select(F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id < 600 THEN 5 ELSE id DIV 2 END").alias("k"), F.expr("nullif(id % 3, 0)").alias("v"))
    want = left.alias("a").join(right.alias("b"), F.expr("a.k = b.k"))
    got = replicate_join(left, right, "k", "k")
    assert got.columns == ["k", "v", "k", "v"]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert replicate_join(left.limit(0), right, "k", "k").isEmpty()
