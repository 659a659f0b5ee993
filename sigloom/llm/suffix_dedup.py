"""Removing repeated byte strings with difference-cover suffix arrays.

Each byte covered by a LENGTH-byte string that also starts earlier goes. Suffixes
are dealt out so that all with an equal LENGTH-byte prefix are in one shard (see
`repeats`; suffixes that no other can equal are left out). Each shard sorts its
suffixes by the difference-cover algorithm: sampled triples are sorted and named,
the names are sorted in turn, and the remaining suffixes are merged in; then
adjacent prefixes of LENGTH bytes are compared. The shards' arrays together are
the slices of the corpus' suffix array in which a repeat can lie.

Defined results: null is the empty text; texts shorter than LENGTH stay whole; a
null doc_id comes before all others; rows with one id and equal texts are one
document, rows with one id and different texts are ordered by a hash of them;
kept bytes are hashed as bytes (a cut may split a code point); an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import arrays as A
from sigloom.llm import repeats as R
from sigloom.llm.suffixes import equal_prefixes, suffix_array

LENGTH, GRAM = 100, 24
SHARD_BYTES = 150_000
PIECE_BYTES = 1 << 18


def _bytes_as_items(buf, offs):
    return A._BYTE_CODES[2][buf], offs


def _byte_cutter(buf, offs):
    whole = buf.tobytes()
    return lambda a, b: whole[a:b], offs


def shape(length: int = LENGTH, gram: int = GRAM) -> R.Shape:
    return R.Shape(_bytes_as_items, _byte_cutter, lambda items, n: [items[o : o + length] for o in range(n)], length, gram, piece=PIECE_BYTES)


def later_windows(length: int):
    """Of a shard's contents: which windows of the first place, and which of the
    later ones, start earlier somewhere. A suffix stands for all places of its
    content; a group of equal prefixes has one earliest place, the others go."""

    def decide(shard: list[R.Content]):
        sizes = np.array([len(c.items) for c in shard])
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        # Each content ends with a symbol of its own, so none is compared beyond it.
        text = np.empty(base[-1], dtype=np.int32)
        inside = np.ones(base[-1], dtype=bool)
        inside[base[1:] - 1] = False
        text[inside] = np.frombuffer(b"".join(c.items for c in shard), np.uint8)
        text[~inside] = 256 + np.arange(len(shard))
        # Documents by (id, text hash), then the window's place: one number in order.
        docs = {d: i for i, d in enumerate(sorted({p[:2] for c in shard for p in (c.lo, c.hi)}))}
        n = np.array([c.n for c in shard])
        starts = np.repeat(base[:-1], n) + _count_up(n)
        first, last = (np.repeat([(docs[p[:2]] << 34) + p[2] for p in places], n) + _count_up(n) for places in ([c.lo for c in shard], [c.hi for c in shard]))
        place, later = np.full(base[-1], -1, dtype=np.int64), np.full(base[-1], -1, dtype=np.int64)
        place[starts], later[starts] = first, last
        order = suffix_array(text)
        order = order[place[order] >= 0]
        same = equal_prefixes(text, order, length)
        heads = np.flatnonzero(~same)
        earliest = np.empty(base[-1], dtype=np.int64)
        earliest[order] = np.repeat(np.minimum.reduceat(place[order], heads), np.diff(np.append(heads, len(order))))
        one, rest = place > earliest, later > earliest
        return [(one[b : b + m], rest[b : b + m]) for b, m in zip(base.tolist(), n.tolist())]

    return decide


def _count_up(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ... n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _cut_out(length: int):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            runs = batch.column("runs")
            for first, last, buf, offs in A.pieces(batch):
                for d in range(first, last):
                    raw = buf[offs[d - first] : offs[d - first + 1]]
                    gone = np.zeros(len(raw), dtype=bool)
                    if runs[d].is_valid:
                        found = runs[d].values.flatten()
                        start = found[0].to_numpy()
                        gone = A.cover(len(raw), start, start + found[1].to_numpy() + length - 1)
                    out["n_bytes"].append(len(raw))
                    out["n_removed"].append(int(gone.sum()))
                    out["n_spans"].append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()))
                    out["kept_sha256"].append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
            ids = batch.column("k").to_pylist()
            cols = [pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([None if i == R.NO_ID else i for i in ids], pa.int64()), *cols], ["doc_id", *out])

    return run


def removed_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, busy: int = R.BUSY) -> DataFrame:
    """(k, t, start, n): all runs of windows that start earlier somewhere."""
    return R.found_runs(docs, shape(length, gram), later_windows(length), SHARD_BYTES, busy)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, busy: int = R.BUSY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return R.marked(docs, removed_runs(docs, length, gram, busy)).mapInArrow(_cut_out(length), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
