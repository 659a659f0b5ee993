"""The pipeline against brute-force versions of its stages, one after another."""

import math
from collections import Counter

import duckdb
import pandas as pd
import test_decontaminate
import test_pii
import test_simhash

import corpus_pipeline
from sigloom.llm import mixing, pii, quality_rules

SF = "/root/testdata/sf0.001"


def slow_pii(rows):
    texts = [r[1] or "" for r in rows]
    spans = [test_pii.slow_spans(t) for t in texts]
    pairs, ents = Counter(), Counter()
    near = [set((e, w) for e, w, _, _ in pii.contexts(t, s)) for t, s in zip(texts, spans)]
    for t, s, p in zip(texts, spans, near):
        ents.update({pii.entity(t, x) for x in s})
        pairs.update(p)
    df = Counter(w for t in texts for w in {pii._term(x) for x in t.split()})
    n = len(texts)
    found = {(e, w) for (e, w), k in pairs.items() if k >= pii.MIN_DOCS and math.log(k * n / (df[w] * ents[e])) >= pii.ALPHA * math.log(n / ents[e]) > 0}
    out = []
    for r, t, s in zip(rows, texts, spans):
        spans_all = sorted({*s, *((a, 4, b) for e, w, a, b in pii.contexts(t, s) if (e, w) in found)})
        new, pos = [], 0
        names = ("EMAIL", "IP", "CARD", "PHONE", "TERM")
        while spans_all:
            a, k, b = spans_all.pop(0)
            while spans_all and spans_all[0][0] < b:
                _, k2, b2 = spans_all.pop(0)
                k, b = min(k, k2), max(b, b2)
            new.append(t[pos:a] + f"<{names[k]}>")
            pos = b
        text = "".join(new) + t[pos:]
        out.append((r[0], text, r[2], r[3], len(text)))
    return out


def test_stages_equal_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    rows = [r for r in con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id").fetchall() if r[0] in good]
    steps = [sorted(rows)]
    low = {d: c for d, _, c in test_simhash.slow_components([r[:2] for r in rows])}
    steps.append([r for r in steps[-1] if low[r[0]] == r[0]])
    items = con.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    bad = {r[0] for r in test_decontaminate.slow([r[:2] for r in steps[-1]], items) if r[-1]}
    steps.append([r for r in steps[-1] if r[0] not in bad])
    steps.append(slow_pii(steps[-1]))
    con.execute("DROP VIEW documents")
    con.register("documents", pd.DataFrame(steps[-1], columns=["doc_id", "text", "lang", "source", "n_chars"]))
    mixed = con.sql(mixing.ORACLES["op9_mixing"])
    cols = mixed.columns

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted(want), name
        docs = spark.createDataFrame(got, docs.schema)
    final = corpus_pipeline.run(spark, SF)
    assert sorted(str(tuple(r)) for r in final.select(*cols).collect()) == sorted(map(str, mixed.fetchall()))
    assert len(steps[0]) > len(steps[1]) > len(steps[2]) > 0


def test_empty_and_odd_documents(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "The plan of the town is in the hands of the people and it is for them to see that all goes well with it."
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (None, text, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert [r.doc_id for r in docs.collect()] == ([2] if rows else [])
