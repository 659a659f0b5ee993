"""Byte-string deduplication against brute force."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import suffix_dedup as D
from sigloom.llm.suffixes import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(text):
    assert suffix_array(np.array(text, dtype=np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def slow(rows, length):
    docs = sorted({(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows})
    seen, gone = set(), {}
    for d, raw in docs:
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                mask[i : i + length] = True
            seen.add(w)
        gone[(d, raw)] = mask
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        m = gone[(-(1 << 63) if d is None else d, raw)]
        spans = int(np.diff(np.concatenate([[0], m.astype(int)])).clip(0).sum())
        out.append((d, len(raw), int(m.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()], key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(D.op5_suffix_dedup(spark, sf)) == slow(rows, 100)


LENGTH = D.LENGTH
SCHEMA = "doc_id long, text string, start string, runs int"


def test_edges(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    a, b = word(90), word(300)
    texts = [a, b, a + b, b + a + b, "x" * 500, "xy" * 300, "x" * 40, None, "", b[:99], b[:140] + "!" + b[140:], word(9000) + b]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "s", 1), (None, "xy" * 60, "s", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(D.deduplicate(df)) == slow([x[:2] for x in rows], 100)


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


def test_strings_that_a_polynomial_confuses(spark):
    rows = [(k, "".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1500)), "s", 1) for k in range(2)]
    rows += [(2, rows[0][1][:700], "s", 1), (3, "c" + rows[1][1][300:900], "s", 1)]
    assert got(D.deduplicate(spark.createDataFrame(rows, SCHEMA))) == slow([x[:2] for x in rows], LENGTH)
