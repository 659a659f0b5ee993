"""Word-window deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import fm_dedup as D
from sigloom.llm.fm_index import FMIndex


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=50), st.integers(1, 6))
def test_matching_statistics(text, cap):
    t = np.array(text, dtype=np.int64)
    got = FMIndex(t).matching_statistics(t, np.arange(1, len(t) + 1), cap)
    for e in range(1, len(text) + 1):
        k = 0
        while k < cap and k < e and sum(text[i : i + k + 1] == text[e - k - 1 : e] for i in range(len(text) - k)) >= 2:
            k += 1
        assert got[e - 1] == k


def slow(rows, length):
    docs = {(d, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    n = Counter(tuple(w[i : i + length]) for w in docs.values() for i in range(len(w) - length + 1))
    out = []
    for d, t in rows:
        w = docs[(d, t)]
        gone = set()
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                gone |= set(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()], key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(D.op2_fm_dedup(spark, sf)) == slow(rows, 35)


LENGTH = D.LENGTH
SCHEMA = "doc_id long, text string, start string, runs int"


def test_edges(spark):
    r = random.Random(4)
    some = lambda n: " ".join(r.choice(["a", "bé", "c,", "D"]) for _ in range(n))
    a, b = some(30), some(120)
    texts = [a, b, a + "\n" + b, b + "\t" + a + " " + b, "x " * 200, "x y " * 100, "x " * 34, None, "", " \n", b.replace("D", "E", 1), some(9000) + " " + b]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "s", 1), (None, "p q " * 40, "s", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = slow(list(dict.fromkeys(x[:2] for x in rows)), 35)
    want = sorted([*want, next(w for w in want if w[0] == 3)], key=str)
    assert got(D.deduplicate(df)) == want


def test_hot_anchors_and_repeated_rows(spark):
    """A passage in many documents, each with surroundings of its own; some rows
    come twice. With few contexts allowed, its edges are compared by windows."""
    r = random.Random(9)
    own = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    passage = own(60)
    rows = [(i, f"{own(40)} {passage} {own(40)}", "s", 1) for i in range(40)] + [(50, own(120), "s", 1)]
    rows += [rows[3], rows[-1]] + [(60 + i, rows[i % 3][1], "s", 1) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = slow([x[:2] for x in rows], LENGTH)
    assert got(D.deduplicate(df)) == want
    assert got(D.deduplicate(df, busy=5)) == want


def test_empty_table(spark):
    assert D.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_a_polynomial_confuses(spark):
    """Thue-Morse words and their complements are different words."""
    head = " ".join(f"w{i}" for i in range(34))
    for n in (8, 64, 512, 1024, 2048):
        rows = [(1, f"{head} {thue_morse(n)}", "s", 1), (2, f"{head} {thue_morse(n, 'b', 'a')}", "s", 1)]
        assert got(D.deduplicate(spark.createDataFrame(rows, SCHEMA))) == slow([x[:2] for x in rows], LENGTH)
    long = [(1, " ".join(thue_morse(1500)), "s", 1), (2, " ".join(thue_morse(1500, "b", "a")), "s", 1)]
    assert got(D.deduplicate(spark.createDataFrame(long, SCHEMA))) == slow([x[:2] for x in long], LENGTH)
