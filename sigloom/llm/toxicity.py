"""Toxicity: a counterfactual-regularised linear classifier.

Features are the words of a document (lower-cased, presence only) and their
first 4, 5 and 6 bytes, so that inflected forms share evidence. The model is a
sparse logistic regression fitted on the driver on a bounded sample of labelled
rows: at most FIT_ROWS of each label, chosen by hash of their ids, equal texts
once, whatever their length. Of their features the MAX_FEATURES with most evidence
(counted on the executors) take part, and those of the sample's identity terms; an L1 penalty
leaves few of them, so that rare words of long texts aren't learnt by heart. For
every labelled sentence of the sample with an identity term, the term is swapped for
the others of its group, and squared changes of the sentence's logit are penalised:
what the score gains from a neutral mention of a group is pressed to nothing. Swaps
are counted on the executors too; the driver sees each different change once.

Scoring is one scan without a shuffle: feature hashes are looked up in the
model, which has at most MAX_FEATURES entries and is all that is broadcast.

Defined results: null and blank texts get the score of no evidence; a null
doc_id is never a training row and is not held out; null labels are skipped; if
one of the two labels is missing, all scores are the share of toxic labels
(0 if there are none); repeated rows score alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import arrays as A
from sigloom.llm.lookup import Lookup
from sigloom.llm.store import Kept

FIT_ROWS = 2000  # of each label
MAX_FEATURES = 16384
FLUSH = 1 << 20  # features that a task holds before it adds them up
MIN_EVIDENCE = 12.0  # a feature's likelihood ratio against independence of the label
TOXIC_WEIGHT = 0.3  # of the toxic rows of the sample, all rows together being 1
PREFIXES = (4, 5, 6)
L1, COUNTERFACTUAL, STEPS = 1e-3, 1.0, 600
#: Identity terms; within a line any may stand for any other.
IDENTITY = (
    "women men girls boys nonbinary".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "gay lesbian bisexual transgender straight heterosexual".split(),
    "black white asian latino indigenous arab".split(),
    "africans europeans americans asians mexicans".split(),
    "immigrants refugees foreigners natives".split(),
    "deaf blind disabled autistic".split(),
    "frauen männer muslime christen juden ausländer".split(),
    "femmes hommes musulmans chrétiens juifs immigrés".split(),
    "mujeres hombres musulmanes cristianos judíos inmigrantes".split(),
)
_GROUP = {t: line for line in IDENTITY for t in line}
_SENTENCE = re.compile(r"[^.!?\n]+")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of each word, one row each kind, and the rows' offsets."""
    low = A.LOWER[buf]
    starts, ends, rows = A.word_spans(low, offs, A.ALNUM)
    kinds = [A.word_hash(low, starts, ends)]
    for k in PREFIXES:
        h = A.word_hash(low, starts, np.minimum(starts + k, ends))
        kinds.append(A.mix(h + A.U64(k)))
    return np.stack(kinds), rows


def _of_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]))[0])


def swaps(text: str) -> list[tuple[str, str]]:
    """(sentence, counterfactual) pairs of a text."""
    out = []
    for s in _SENTENCE.findall(text):
        for m in re.finditer(r"\w+", s):
            for other in _GROUP.get(m.group().lower(), ()):
                if other != m.group().lower():
                    out.append((s, s[: m.start()] + other + s[m.end() :]))
    return out


def _counts(batches):
    """(feature, n1, n): the texts with each feature, and the toxic ones of them."""

    def rows(held: list) -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for _, k in held]), return_inverse=True)
        label = np.repeat([t for t, _ in held], [len(k) for _, k in held])
        n1, n = np.bincount(at, label, len(keys)), np.bincount(at, minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n1.astype(np.int64)), pa.array(n.astype(np.int64))], ["feature", "n1", "n"])

    held, size = [(0, np.empty(0, np.uint64))], 0
    for batch in batches:
        for toxic, v in zip(batch.column("toxic").to_pylist(), batch.column("text")):
            held.append((toxic, _of_text(v.as_py() or "")))
            size += len(held[-1][1])
            if size > FLUSH:
                yield rows(held)
                held, size = [(0, np.empty(0, np.uint64))], 0
    yield rows(held)


def _evidence(t1: int, t: int) -> Column:
    """Likelihood ratio (G) of a feature's counts against independence: n1 of its n
    texts are toxic, t1 of all t."""
    n1, n = F.col("n1"), F.col("n")
    cells = ((n1, n * t1 / t), (n - n1, n * (t - t1) / t), (t1 - n1, (t - n) * t1 / t), (t - n - t1 + n1, (t - n) * (t - t1) / t))
    return 2 * sum((F.when(k > 0, k * F.log(k / e)).otherwise(0.0) for k, e in cells), F.lit(0.0))


_KINDS = "kind int, toxic int, added array<long>, dropped array<long>"


def _sample_rows(keys):
    """Of each text of the sample the features that take part (kind 0), and those that
    each swap adds and drops (kind 1)."""

    def run(batches):
        look = Lookup(keys.value)
        own = lambda text: np.unique(look.find(_of_text(text))[1])
        for batch in batches:
            out = {"kind": [], "toxic": [], "added": [], "dropped": []}
            for toxic, v in zip(batch.column("toxic").to_pylist(), batch.column("text")):
                text = v.as_py() or ""
                rows = [(0, toxic, own(text), None)]
                for a, b in swaps(text):
                    a, b = own(a), own(b)
                    rows.append((1, None, np.setdiff1d(b, a), np.setdiff1d(a, b)))
                for row in rows:
                    for c, x in zip(out.values(), row):
                        c.append(x)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("kind", pa.int32()), ("toxic", pa.int32()), ("added", longs), ("dropped", longs)]))

    return run


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def logits(self, kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of a piece's documents; a feature counts once in each."""
        total = np.full(len(rows) - 1, self.bias)
        look = Lookup(self.keys)
        pairs = [np.empty(0, np.int64)]
        for h in kinds:
            at, key = look.find(h)
            doc = np.searchsorted(rows, at, side="right") - 1
            pairs.append(doc * len(self.keys) + key)
        if len(self.keys):
            doc, key = np.divmod(np.unique(np.concatenate(pairs)), len(self.keys))
            np.add.at(total, doc, self.weights[key])
        return total


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(keys: np.ndarray, docs: list[np.ndarray], toxic: np.ndarray, pairs: list[tuple], share: float, penalty: float = COUNTERFACTUAL) -> Model:
    """Accelerated proximal gradient on weighted log loss, L1, and the counterfactual
    penalty: the mean squared change of a swap's logit. docs: places of their features
    in keys; pairs: (places added, places dropped, how often); share: of toxic rows
    among all labelled ones, for want of one label."""
    if not len(docs) or toxic.all() or not toxic.any() or not len(keys):
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(max(share, 1e-17) / max(1 - share, 1e-17))))
    doc, f = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate(docs).astype(np.int64)
    weight = np.where(toxic, TOXIC_WEIGHT / toxic.sum(), (1 - TOXIC_WEIGHT) / (~toxic).sum())
    # Counterfactual differences as (pair, feature, +1 or -1).
    hits = [(p, np.asarray(side, np.int64), sign) for p, pair in enumerate(pairs) for side, sign in zip(pair, (1.0, -1.0))]
    dp = np.concatenate([np.full(len(h), p) for p, h, _ in hits] or [np.empty(0)]).astype(int)
    df = np.concatenate([h for _, h, _ in hits] or [np.empty(0)]).astype(int)
    dv = np.concatenate([np.full(len(h), sign) for _, h, sign in hits] or [np.empty(0)])
    times = np.array([n for _, _, n in pairs], float)
    pull = 2 * penalty * times / max(1, times.sum())
    # Row sums bound the curvature of both parts.
    size = np.bincount(doc, minlength=len(docs)) + 1
    curve = 0.25 * max(np.bincount(f, (weight * size)[doc], len(keys)).max(), (weight * size).sum())
    if len(dp):
        curve += np.bincount(df, (pull * np.bincount(dp, minlength=len(pairs)))[dp], len(keys)).max()
    w, at_w, b, at_b, t = np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0, 1.0
    for _ in range(STEPS):
        error = weight * (_sigmoid(at_b + np.bincount(doc, at_w[f], len(docs))) - toxic)
        grad = np.bincount(f, error[doc], len(keys))
        if len(dp):
            change = pull * np.bincount(dp, dv * at_w[df], len(pairs))
            grad += np.bincount(df, dv * change[dp], len(keys))
        step = at_w - grad / curve
        new_w, new_b = np.sign(step) * np.maximum(np.abs(step) - L1 / curve, 0), at_b - error.sum() / curve
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w, at_b = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    keep = w != 0
    return Model(keys[keep], w[keep], float(b))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, penalty: float = COUNTERFACTUAL) -> Model:
    spark = docs.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    first = lambda label: known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = Kept(docs.select("doc_id", "text").join(F.broadcast(first(0).union(first(1))), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")).distinct(), "sample")
    sums = sample.df.agg(F.sum("toxic"), F.count("*")).first()
    t1, t = sums[0] or 0, sums[1]
    if not 0 < t1 < t:
        return train(np.empty(0, np.uint64), [], np.empty(0, bool), [], share)
    counts = sample.df.mapInArrow(_counts, "feature long, n1 long, n long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n")).withColumn("worth", _evidence(t1, t))
    best = counts.orderBy(F.desc("worth"), "feature").limit(MAX_FEATURES).select("feature", "worth").toArrow()
    worth, found = best.column("worth").to_numpy(), best.column("feature").to_numpy().view(np.uint64)
    least = min(MIN_EVIDENCE, worth.max() / 2) if len(worth) else 0
    # Identity terms take part however rare they are, but not where no text has them:
    # the penalty could then raise an unseen term's weight to that of a seen one.
    terms = np.unique(np.concatenate([_of_text(term) for term in _GROUP])).view(np.int64).tolist()
    seen = counts.filter(F.col("feature").isin(terms)).select("feature").toArrow().column("feature").to_numpy().view(np.uint64)
    keys = np.unique(np.concatenate([found[worth > least], seen]))
    rows = sample.df.mapInArrow(_sample_rows(spark.sparkContext.broadcast(keys)), _KINDS).groupBy("kind", "toxic", "added", "dropped").agg(F.count("*").alias("n")).toArrow().to_pylist()
    sample.drop()
    # Rows arrive in any order; a fixed one keeps sums, and so scores, the same.
    texts = sorted((r["toxic"], r["added"], r["n"]) for r in rows if r["kind"] == 0)
    pairs = sorted((r["added"], r["dropped"], r["n"]) for r in rows if r["kind"] == 1)
    own = [np.array(d, np.int64) for _, d, n in texts for _ in range(n)]
    return train(keys, own, np.array([label for label, _, n in texts for _ in range(n)], bool), pairs, share, penalty)


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            scores = [np.empty(0)]
            for _, _, buf, offs in A.pieces(batch):
                scores.append(_sigmoid(m.logits(*features(buf, offs))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(bc), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op1_toxicity": op1_toxicity}
