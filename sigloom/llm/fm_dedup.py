"""Removing repeated word windows with compressed FM-indexes.

A window is LENGTH words; each word of a window whose words also start anywhere
else goes, in every copy. Windows are dealt out so that all equal ones are in one
shard (see `repeats`; windows that no other can equal are left out). A shard's
words become its own alphabet, told apart by their bytes, and its text the
Burrows-Wheeler transform in a wavelet tree. The documents' contexts are then
streamed through backward search, which gives each place's matching statistic,
the longest string ending there that the index holds twice or more; where it
reaches LENGTH, the window is reported.

Defined results: null text has no words; texts under LENGTH words stay whole; a
null doc_id is an id of its own; rows with one id and equal texts are one
document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import arrays as A
from sigloom.llm import repeats as R
from sigloom.llm.fm_index import FMIndex

LENGTH, GRAM = 35, 14
SHARD_BYTES = 600_000


def _words_as_items(buf, offs):
    starts, ends, rows = A.word_spans(buf, offs, A.BLANK)
    return A.word_hash(buf, starts, ends), rows


def _word_cutter(buf, offs):
    starts, ends, rows = A.word_spans(buf, offs, A.BLANK)
    starts, ends, whole = starts.tolist(), ends.tolist(), buf.tobytes()
    # Blanks of any kind become one space, so equal words are equal bytes.
    return lambda a, b: b" ".join(whole[starts[a] : ends[b - 1]].split()), rows


def _windows(length: int):
    def of(items: bytes, n: int) -> list[bytes]:
        words = items.split(b" ")
        return [b" ".join(words[o : o + length]) for o in range(n)]

    return of


def shape(length: int = LENGTH, gram: int = GRAM) -> R.Shape:
    return R.Shape(_words_as_items, _word_cutter, _windows(length), length, gram)


def repeated_windows(length: int):
    """Of a shard's contents: which windows of the first occurrence, and which of a
    later one, the index holds twice or more."""

    def decide(shard: list[R.Content]):
        symbols: dict[bytes, int] = {}
        number = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in c.items.split(b" ")]) for c in shard]
        # What occurs twice or more is in the index twice, behind the others.
        copies = [x for x, c in zip(number, shard) if c.lo != c.hi]
        base = np.concatenate([[0], np.cumsum([len(x) + 1 for x in number + copies])])
        text = np.zeros(base[-1], dtype=np.int64)  # 0 parts the contents
        inside = np.ones(base[-1], dtype=bool)
        inside[base[1:] - 1] = False
        text[inside] = np.concatenate(number + copies)
        index, searched = FMIndex(text), np.where(inside, text, -1)
        first, n = base[: len(shard)], np.array([c.n for c in shard])
        # The string that ends with the content: all windows inside it are repeated.
        end = first + n + length - 1
        back = end - index.matching_statistics(searched, end, int(n.max()) + length)
        twice = A.cover(len(text) + 1, np.minimum(back, end - length + 1), end - length + 1)
        # Where that isn't all of it, each other window by itself; of the last one it
        # is known.
        part = (back > first) & (n > 1)
        ends = np.concatenate([np.empty(0, np.int64), *(np.arange(f, f + m - 1) for f, m in zip(first[part].tolist(), n[part].tolist()))]) + length
        ends = ends[~twice[ends - length]]
        twice[ends - length] = index.matching_statistics(searched, ends, length) >= length
        return [(m, m) for m in (twice[b : b + c.n] for b, c in zip(base.tolist(), shard))]

    return decide


def _cut_out(length: int):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("n_words", "n_removed", "kept_sha256")}
            runs = batch.column("runs")
            for first, last, buf, offs in A.pieces(batch):
                starts, _, rows = A.word_spans(buf, offs, A.BLANK)
                whole = buf.tobytes()
                for d in range(first, last):
                    words = whole[offs[d - first] : offs[d - first + 1]].split()
                    gone = None
                    if runs[d].is_valid:
                        found = runs[d].values.flatten()
                        start = found[0].to_numpy()
                        gone = A.cover(len(words), start, start + found[1].to_numpy() + length - 1)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    out["n_words"].append(int(rows[d - first + 1] - rows[d - first]))
                    out["n_removed"].append(0 if gone is None else int(gone.sum()))
                    out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
            ids = batch.column("k").to_pylist()
            cols = [pa.array(v, pa.string() if c == "kept_sha256" else pa.int64()) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([None if i == R.NO_ID else i for i in ids], pa.int64()), *cols], ["doc_id", *out])

    return run


def removed_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, busy: int = R.BUSY) -> DataFrame:
    """(k, t, start, n): all runs of windows that occur elsewhere too."""
    return R.found_runs(docs, shape(length, gram), repeated_windows(length), SHARD_BYTES, busy)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, busy: int = R.BUSY) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return R.marked(docs, removed_runs(docs, length, gram, busy)).mapInArrow(_cut_out(length), schema)


def op2_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_fm_dedup": op2_fm_dedup}
