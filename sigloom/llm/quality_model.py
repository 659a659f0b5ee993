"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of each document (lengths, character and line shares, repetition)
are standardised and mapped to FEATURES random cosines, whose inner products
approximate a Gaussian kernel. Every partition of the training rows sums its
part of the normal equations, the parts are summed by fold and row of the matrix,
and the driver solves one system of FEATURES + 1 unknowns over all folds, and one
without each fold. Every training row is scored by the system that hasn't seen its
fold; these scores are binned, and pool-adjacent-violators on the bins' label shares
gives a monotone calibration.

The text is read once: statistics are written to the shared folder and serve
both fitting and scoring. Training rows are bounded: with more than FIT_ROWS of
them, those whose hash is under the fitting share are taken.

Defined results: null and blank texts have zero statistics and are scored like
any other; a null doc_id is never a training row and is not held out; null
labels are skipped; without labels all scores are 0.5; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import arrays as A
from sigloom.llm.store import Kept
from sigloom.llm.toxicity import held_out

FEATURES, WIDTH, RIDGE, SEED = 192, 0.35, 1e-3, 7
FIT_ROWS = 200_000
PARTS = 64  # partitions of the training rows, at most
BINS = 512
FOLDS = 4
STATS = (
    "log_words", "log_bytes", "word_bytes", "word_spread", "upper", "digit", "symbol", "exclaim", "point", "line_words",
    "other_bytes", "distinct_words", "echo", "common_words", "piped_words", "repeated_lines", "first_upper", "long_words",
)
#: The commonest function words of the corpus' languages.
COMMON = "the of and to in is that it for was with der die und den von zu das mit de la le les et des est pour el que y los se del las por".split()


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL, _POINT = _class("#*$%&|<>"), _class(".,;:?")
_NOT_BREAK = ~_class("\n")


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return A.word_hash(raw, np.array([0]), np.array([len(raw)]))[0]


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The STATS of each document of a piece, one row each."""
    starts, ends, rows = A.word_spans(buf, offs, A.BLANK)
    words, low = A.word_hash(buf, starts, ends), A.word_hash(A.LOWER[buf], starts, ends)
    n, size = np.diff(rows).astype(float), np.diff(offs).astype(float)

    def per_doc(mask, at):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[at])

    share = lambda mask: per_doc(mask, offs) / np.maximum(size, 1)
    by_word = lambda mask: per_doc(mask, rows) / np.maximum(n, 1)
    length = ends - starts
    mean = per_doc(length, rows) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(per_doc(length.astype(float) ** 2, rows) / np.maximum(n, 1) - mean**2, 0))
    echo = np.zeros(len(words), bool)
    echo[1:] = words[1:] == words[:-1]
    echo[rows[:-1][n > 0]] = False
    lone_pipe = (length == 1) & (buf[starts] == ord("|")) if len(starts) else np.zeros(0, bool)
    line_a, line_b, lines = A.word_spans(buf, offs, _NOT_BREAK)
    line_hash = A.word_hash(buf, line_a, line_b)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(rows[:-1], rows[1:])])
    distinct_lines = np.array([len(np.unique(line_hash[a:b])) for a, b in zip(lines[:-1], lines[1:])])
    n_lines = np.diff(lines)
    common = np.isin(low, np.array([_hash_of(w) for w in COMMON], np.uint64))
    return np.column_stack([
        np.log1p(n), np.log1p(size), mean, spread,
        share(_UPPER[buf]), share(_DIGIT[buf]), share(_SYMBOL[buf]), share(buf == ord("!")), share(_POINT[buf]),
        np.log1p(n / np.maximum(n_lines, 1)), share(buf >= 128), distinct / np.maximum(n, 1), by_word(echo), by_word(common),
        by_word(lone_pipe), (n_lines - distinct_lines) / np.maximum(n_lines, 1), by_word(_UPPER[buf[starts]] if len(starts) else np.zeros(0, bool)), by_word(length > 20),
    ])


def _stats(batches):
    for batch in batches:
        x = np.concatenate([np.empty((0, len(STATS))), *(statistics(buf, offs) for _, _, buf, offs in A.pieces(batch))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), *(pa.array(c) for c in x.T)], ["doc_id", "held_out", *STATS])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # of the features, the last of the constant; None without labels
    knots: np.ndarray  # raw scores of the calibration
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        r = np.random.default_rng(SEED)
        w = r.normal(0, WIDTH, (x.shape[1], FEATURES))
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ w + r.uniform(0, 2 * np.pi, FEATURES)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.knots, self.values)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATS])


def _normal_parts(model):
    """A partition's sums of features x (features, label), a row for each fold and feature."""

    def run(batches):
        m, total = model.value, np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x, fold = np.column_stack([m.features(_matrix(batch)), batch.column("label").to_numpy(zero_copy_only=False)]), batch.column("fold").to_numpy()
            for k in range(FOLDS):
                own = x[fold == k]
                total[k] += own[:, :-1].T @ own
        fold, i = np.divmod(np.arange(FOLDS * (FEATURES + 1)), FEATURES + 1)
        yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(list(total.reshape(-1, FEATURES + 2)), pa.list_(pa.float64()))], ["fold", "i", "part"])

    return run


def _sum_parts(key, table):
    total = np.sum([np.asarray(v.values) for v in table.column("part")], axis=0)
    return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([total], pa.list_(pa.float64()))})


def solve(total: np.ndarray) -> np.ndarray:
    """Ridge weights from sums of features x (features, label)."""
    n = max(1.0, total[-1, -2])  # the last feature is 1
    return np.linalg.solve(total[:, :-1] + RIDGE * n / FEATURES * np.eye(FEATURES + 1), total[:, -1])


def _bins(model, weights, low, high):
    """Rows and label sums of the bins of scores by the weights that haven't seen a row's fold."""

    def run(batches):
        n, s = np.zeros(BINS, np.int64), np.zeros(BINS)
        for batch in batches:
            raw = (model.value.features(_matrix(batch)) * weights[batch.column("fold").to_numpy()]).sum(axis=1)
            at = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, batch.column("label").to_numpy(zero_copy_only=False), BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(n), pa.array(s)], ["bin", "n", "s"])

    return run


def isotonic(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Non-decreasing fit of s / n with weights n, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for k, (a, b) in enumerate(zip(n, s)):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    return np.concatenate([np.full(int(c), b / a) for a, b, c in blocks])


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """stats: doc_id, held_out and STATS of the documents."""
    sc = stats.sparkSession.sparkContext
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    rows = stats.filter(~F.col("held_out")).join(known, "doc_id")
    n = rows.count()
    if n > fit_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * fit_rows / n))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    kept = Kept(rows.select("label", fold.alias("fold"), *STATS).coalesce(PARTS), "training")
    rows = kept.df
    moments = rows.agg(F.count("*"), *(f(c) for c in STATS for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), None, np.array([0.0]), np.array([0.5]))
    mean, std = np.array(moments[1::2], float), np.array(moments[2::2], float)
    model = Model(mean, np.maximum(std, 1e-6), None, np.array([0.0]), np.array([0.5]))
    schema = "fold int, i int, part array<double>"
    parts = rows.mapInArrow(_normal_parts(sc.broadcast(model)), schema).groupBy("fold", "i").applyInArrow(_sum_parts, schema)
    folds = np.array([r["part"] for r in parts.orderBy("fold", "i").collect()]).reshape(FOLDS, FEATURES + 1, FEATURES + 2)
    total = folds.sum(axis=0)
    model.weights = solve(total)
    unseen = np.array([solve(total - f) for f in folds])
    low, high = -0.5, 1.5
    bins = rows.mapInArrow(_bins(sc.broadcast(model), unseen, low, high), "bin int, n long, s double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > 0").orderBy("bin").collect()
    model.knots = low + (np.array([r["bin"] for r in bins]) + 0.5) * (high - low) / BINS
    model.values = isotonic(np.array([r["n"] for r in bins], float), np.array([r["s"] for r in bins], float))
    kept.drop()
    return model


def _score(model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.score(_matrix(batch)))], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    schema = "doc_id long, held_out boolean, " + ", ".join(f"{c} double" for c in STATS)
    stats = Kept(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_stats, schema), "statistics").df
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))
    scored = stats.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op4_quality_model": op4_quality_model}
