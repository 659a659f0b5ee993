"""Connected components against union-find."""

import random

from sigloom.llm.components import roots
from sigloom.llm.store import Kept, files_for, input_bytes, partitions_for


def truth(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


def test_random_graphs_chains_and_hubs(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    edges += [(5000, 5001 + i) for i in range(200)]  # a hub
    edges += [(7, 7), (8, 9), (9, 8), (8, 9), (-5, 3)]
    got = roots(spark.createDataFrame(edges, "x long, y long"))
    rows = [(x.u, x.v) for x in got.df.collect()]
    assert len(rows) == len(dict(rows))
    assert dict(rows) == truth(edges)


def test_no_edges(spark):
    assert roots(spark.createDataFrame([], "a long, b long")).df.count() == 0
    assert roots(spark.createDataFrame([(4, 4)], "a long, b long")).df.count() == 0


def test_files_follow_the_size_and_not_the_partitions(spark):
    """60 edges need no file for each of 16 shuffle partitions."""
    hold = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in hold}
    edges = [(3 * i, 3 * i + 1 + i % 2) for i in range(60)]
    given = Kept(spark.createDataFrame(edges, "x long, y long"), "given")
    try:
        for k, v in hold.items():
            spark.conf.set(k, v)
        got = roots(given.df)
        assert len(got.df.inputFiles()) == 1
        assert {x.u: x.v for x in got.df.collect()} == truth(edges)
    finally:
        given.drop()
        for k, v in old.items():
            spark.conf.set(k, v)


def test_larger_tables_get_more_files(spark):
    given = Kept(spark.range(100_000).selectExpr("xxhash64(id) x", "xxhash64(id + 1) y"), "given")
    size = input_bytes(given.df)
    assert files_for(given.df) == 1
    assert files_for(given.df, size // 3 + 1) == 3
    assert files_for(given.df, 1000) == partitions_for(given.df)
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1, 2)]), "a long, b long")
    assert files_for(unknown) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    given.drop()
