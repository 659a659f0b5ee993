"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from sigloom.llm import simhash as S
from sigloom.llm.store import Kept

SCHEMA = "doc_id long, text string, fp string, component_id long"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\f\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    return components_of(fps)


def components_of(fps):
    distinct = np.array(sorted({f for _, f in fps}), dtype=np.uint64)
    parent = {int(f): int(f) for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in enumerate(distinct):
        for g in distinct[i + 1 :][np.bitwise_count(distinct[i + 1 :] ^ f) <= 3]:
            parent[find(int(g))] = find(int(f))
    low = {}
    for d, f in fps:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return sorted(((d, f"{f:016x}", low.get(find(f))) for d, f in fps), key=str)


def got(df):
    return sorted([(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()], key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(S.op7_simhash(spark, sf)) == slow_components(rows)


def test_edges(spark):
    rows = [(1, None, "x", 9), (2, "", "y", 9), (3, " \n", "z", 9), (4, "A b", None, 9), (5, "a B", "q", 9), (None, "a b", "q", 9), (7, "word " * 5000, "q", 9), (7, "word " * 5000, "q", 9), (8, "é x y z", "q", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(S.near_duplicates(df)) == slow_components([r[:2] for r in rows])
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 7, 8]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(df).count() == 0
    assert S.keep_one(df).count() == 0


@pytest.mark.parametrize("bucket", [4, 2048])
def test_links_keep_every_connection(spark, bucket):
    """A dense cloud, chains, a hot bucket and noise; a small bucket size forces rounds."""
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        f = centre
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2))))
            f ^= sum(1 << b for b in r.sample(range(64), 3))
            fps.add(f)
    fps |= {r.getrandbits(64) for _ in range(100)}
    # All agree in the first 40 bits, so every bucket of some keys is hot.
    base = r.getrandbits(40)
    fps |= {base | r.getrandbits(24) << 40 for _ in range(600)}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    table = S.link_table(df, bucket)
    assert (bucket == 4) == (not S.links(df, bucket).filter('b IS NULL').isEmpty())
    from sigloom.llm.components import roots

    pairs = [(x.a, x.b) for x in table.df.filter("b IS NOT NULL").collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    star = roots(table.df.filter("b IS NOT NULL").select("a", "b"))
    label = {x.u: x.v for x in star.df.collect()}
    mine = {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        mine.setdefault(label.get(s, s), set()).add(f)
    parts = sorted(map(sorted, mine.values()))
    ids = sorted(fps)
    truth = {}
    for d, _, c in components_of(list(enumerate(ids))):
        truth.setdefault(c, []).append(ids[d])
    assert parts == sorted(map(sorted, truth.values()))


def test_keep_one_of_each_group_with_repeated_ids(spark):
    """An id with different texts stands for each of their groups."""
    a, b, c = ("one two three four five six", "red green blue black white grey", "north south east west up down")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (5, c), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = S.keep_one(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted([(1, a), (1, b), (4, c)])


def test_keys_of_later_rounds_miss_no_pair():
    """Two fingerprints that agree under a key share one of its four deeper keys."""
    r = random.Random(6)
    for number in range(len(S.KEYS)):
        for _ in range(5):
            m = S.mask_of(number)
            free = [b for b in range(64) if not m >> b & 1]
            diff = sum(1 << b for b in r.sample(free, 3))
            assert any(diff & S.mask_of(d) == 0 for d in S._deeper(number))
            number = r.choice(S._deeper(number))


def test_keep_one_is_the_same_in_any_order(spark):
    """Five rows, of which only text a is there twice; and near copies under one id."""
    a, b, c, d = ("one two three four five six", "red green blue black white grey", "north south east west up down", "tin iron gold lead zinc silver")
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (6, c, None), (6, d, "w"), (6, d, "v")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        got = sorted(map(tuple, S.keep_one(df).collect()))
        assert [x[:2] for x in got] == [(1, a), (5, b), (6, c), (6, d)] and (6, d, "v") in got


@pytest.mark.parametrize("bucket", [4, 2048])
def test_links_are_few_files(spark, bucket):
    """200 fingerprints need no file for each of 16 tasks that compare them."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    fps = spark.range(100).selectExpr("explode(array(xxhash64(id), xxhash64(id) ^ 5)) fp")
    kept = Kept(fps, "given")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        table = S.link_table(kept.df, bucket)
        assert len(table.df.inputFiles()) == 1
        linked = {frozenset(r) for r in table.df.filter("b IS NOT NULL").select("a", "b").collect()}
        assert linked == {frozenset((r.x, r.x ^ 5)) for r in spark.range(100).selectExpr("xxhash64(id) x").collect()}
        table.drop()
    finally:
        kept.drop()
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_join_with_groups_deals_both_sides(spark):
    """However small the groups are: a side that stays as it was dealt can't be split."""
    docs = spark.createDataFrame([(k, f"a b c {k % 7}") for k in range(40)], "doc_id long, text string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    sig, comp = S.groups(docs)
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = sig.df.hint("merge").join(comp, "fp")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        sig.drop()
    joins = [line for line in plan.splitlines() if "SortMergeJoin [fp#" in line and "Inner" in line]
    assert len(joins) == 1
    assert "SortMergeJoin [root#" in plan
