"""Held-out accuracy, calibration, the counterfactual penalty, and odd inputs."""

import numpy as np
import pytest

from sigloom.llm import quality_model as Q
from sigloom.llm import toxicity as T

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, held_out string, toxic int"


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels, bool)
    ranks = np.argsort(np.argsort(s)) + 1
    return (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(T.op1_toxicity, "toxic", 0.93), (Q.op4_quality_model, "quality", 0.97)])
def test_held_out(spark, query, label, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 500 and docs.count() == 10000
    assert all(0 <= r.score <= 1 for r in rows)
    assert auc([r.score for r in rows], [r[label] for r in rows]) > least
    assert np.mean([r.predicted == r[label] for r in rows]) > 0.96


def biased(spark):
    """Texts in which a group's name goes with the label by accident."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        terms = [f"w{j}" for j in rng.integers(0, 50, 6)]
        terms += ["slur"] * (bad and rng.random() < 0.7) + ["muslims"] * bool(rng.random() < (0.8 if bad else 0.1))
        rows.append((i, " ".join(terms)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_counterfactual_penalty_changes_predictions(spark):
    """A neutral mention is no longer toxic, a slur still is."""
    docs, labels = biased(spark)
    asked = spark.createDataFrame([(1, "w1 w2 w3 muslims w4"), (2, "w1 w2 w3 christians w4"), (3, "w1 w2 slur w4")], "doc_id long, text string")
    free, bound = ({r.doc_id: r for r in T.score(asked, T.fit(docs, labels, penalty=p)).collect()} for p in (0.0, 30.0))
    assert [free[k].predicted for k in (1, 2, 3)] == [1, 0, 1]
    assert [bound[k].predicted for k in (1, 2, 3)] == [0, 0, 1]
    assert bound[1].score - bound[2].score < 0.2 * (free[1].score - free[2].score)
    assert ("we saw women here", "we saw men here") in T.swaps("we saw women here. bye")


def test_training_equals_plain_gradient_descent():
    """The fitted weights are the minimum that a plain slow descent finds."""
    rng = np.random.default_rng(1)
    keys = np.arange(1, 9, dtype=np.uint64)
    docs = [np.flatnonzero(rng.random(8) < 0.4) for _ in range(200)]
    toxic = np.array([(0 in d) or rng.random() < 0.2 for d in docs])
    pairs = [(np.array([0]), np.array([1]), 3), (np.array([2, 3]), np.array([4]), 1)]
    m = T.train(keys, docs, toxic, pairs, 0.3, penalty=0.5)
    x = np.zeros((len(docs), 8))
    for i, d in enumerate(docs):
        x[i, d] = 1
    d = np.array([[1, -1, 0, 0, 0, 0, 0, 0], [0, 0, 1, 1, -1, 0, 0, 0]], float)
    weight = np.where(toxic, T.TOXIC_WEIGHT / toxic.sum(), (1 - T.TOXIC_WEIGHT) / (~toxic).sum())

    def loss(w, b):
        z = x @ w + b
        return (weight * (np.logaddexp(0, z) - toxic * z)).sum() + 0.5 * ((d @ w) ** 2 * [3, 1]).sum() / 4 + T.L1 * np.abs(w).sum()

    got = np.zeros(8)
    got[(m.keys - 1).astype(int)] = m.weights
    w, b = np.zeros(8), 0.0
    for _ in range(20000):
        e = weight * (1 / (1 + np.exp(-(x @ w + b))) - toxic)
        step = w - 0.5 * (x.T @ e + d.T @ ((d @ w) * [3, 1]) / 4)
        w, b = np.sign(step) * np.maximum(np.abs(step) - 0.5 * T.L1, 0), b - 0.5 * e.sum()
    assert abs(loss(got, m.bias) - loss(w, b)) < 1e-6 and np.allclose(got, w, atol=0.02)


def test_long_training_texts_count(spark):
    """Rows are sampled by their number, never by their length."""
    rng = np.random.default_rng(2)
    long = " ".join(f"x{j}" for j in rng.integers(0, 10**6, 12000))
    rows = [(i, ("slur " if i % 2 else "fine ") + long + f" {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    m = T.fit(docs, labels)
    assert T._of_text("slur")[0] is not None and np.isin(T._of_text("slur"), m.keys).any()


def test_quality_equals_brute_force(spark, sf):
    """Normal equations over all rows at once, and calibration on scores of rows that
    the scoring weights haven't seen."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    cols = "doc_id long, held_out boolean, " + ", ".join(f"{c} double" for c in Q.STATS)
    stats = docs.select("doc_id", T.held_out(docs.doc_id).alias("held_out"), "text").mapInArrow(Q._stats, cols)
    m = Q.fit(stats, labels)
    from pyspark.sql import functions as F

    rows = stats.filter("NOT held_out").join(labels.select("doc_id", "quality"), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(Q.FOLDS))).collect()
    x, y, fold = np.array([[r[c] for c in Q.STATS] for r in rows]), np.array([float(r.quality) for r in rows]), np.array([r.fold for r in rows])
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.scale, np.maximum(x.std(axis=0), 1e-6))
    f = m.features(x)

    def ridge(a, b):
        return np.linalg.lstsq(np.vstack([a, np.sqrt(Q.RIDGE * len(a) / Q.FEATURES) * np.eye(a.shape[1])]), np.concatenate([b, np.zeros(a.shape[1])]), rcond=None)[0]

    assert np.allclose(m.weights, ridge(f, y), atol=1e-6)
    raw = np.array([f[i] @ ridge(f[fold != fold[i]], y[fold != fold[i]]) for i in range(len(f))])
    at = np.clip(((raw + 0.5) / 2 * Q.BINS).astype(int), 0, Q.BINS - 1)
    used = np.unique(at)
    assert np.allclose(m.knots, -0.5 + (used + 0.5) * 2 / Q.BINS)
    want = np.array([y[at == k].mean() for k in used])
    n = np.array([(at == k).sum() for k in used])
    for i in range(len(used)):  # the min-max formula of isotonic regression
        best = max(min(np.average(want[a : b + 1], weights=n[a : b + 1]) for b in range(i, len(used))) for a in range(i + 1))
        assert abs(m.values[i] - best) < 1e-9


def test_isotonic():
    n, s = np.array([2.0, 2, 1, 4]), np.array([0.0, 2, 0, 4])
    assert Q.isotonic(n, s).tolist() == [0, 2 / 3, 2 / 3, 1]


def test_edges(spark):
    rows = [(None, "text", "a", "b", 1), (1, None, "a", "b", 0), (2, "", "a", "b", 1), (3, "word " * 30000, "a", "b", 0), (3, "word " * 30000, "a", "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, None), (None, 0, 1), (9, None, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        for out in (T.score(df, T.fit(df, lab)), Q.score(df, lab)):
            got = out.collect()
            assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(got) == 5
            assert all(0 <= r.score <= 1 for r in got)
            assert next(r for r in got if r.doc_id is None).held_out is False
            assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert T.score(df.limit(0), T.fit(df.limit(0), labels)).count() == 0
    assert Q.score(df.limit(0), labels).count() == 0
