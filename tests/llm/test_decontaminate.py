"""Decontamination against brute force."""

import hashlib
import random
import re

from sigloom.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item string, n_words string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(13, len(w))
        if size and i is not None:
            for p in range(len(w) - size + 1):
                windows.setdefault(tuple(w[p : p + size]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for s in sizes:
            for p in range(len(w) - s + 1):
                if names := windows.get(tuple(w[p : p + s])):
                    hit |= set(range(p, p + s))
                    found |= names
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()], key=str)


def make(spark):
    r = random.Random(2)
    some = lambda n: " ".join(r.choice("alpha Beta gämma d3 e".split()) for _ in range(n))
    items = [(1, some(40)), (2, some(13)), (3, "Only Five-words: here, now"), (4, None), (5, ""), (6, "zebra"), (7, some(13)), (None, some(20)), (12, "zebra"), (2, some(14))]
    texts = [items[0][1].upper(), some(300) + "; " + items[1][1], "x only five words here now y", None, "", "ZEBRA!", some(50), "no " * 400 + "zebra", "zebra " * 30, some(20000)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, items[0][1]), (1, texts[1]), (1, texts[1])]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    return docs, df, items, spark.createDataFrame(items, "item_id long, text string")


def test_brute_force_and_blocks(spark):
    docs, df, items, bench = make(spark)
    assert got(D.contamination(spark, df, bench)) == slow(docs, items)
    assert got(D.contamination(spark, df, bench, block_windows=9)) == slow(docs, items)
    kept = D.drop_contaminated(spark, df, bench)
    assert kept.columns == df.columns
    want = [d for (d, t) in docs if not slow([(d, t)], items)[0][-1]]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    _, df, _, bench = make(spark)
    assert D.contamination(spark, df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in D.contamination(spark, df, bench.limit(0)).collect())


def test_words_that_a_polynomial_confuses(spark):
    """A Thue-Morse word and its complement are different words."""
    for n in (8, 512, 1024, 4096):
        one, two = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(n)) for k in range(2))
        seq = [" ".join(f"w{(bin(i).count('1') + k) % 2}" for i in range(1500)) for k in range(2)]
        docs, items = [(1, one), (2, f"x {two}"), (3, seq[0])], [(1, two), (2, seq[1])]
        df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        assert got(D.contamination(spark, df, bench)) == slow(docs, items)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(D.op10_decontaminate(spark, sf)) == slow(docs, items)
