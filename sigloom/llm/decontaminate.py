"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item becomes windows of 13 words (a shorter item: one window).
A window's shingles (five words; fewer if the window is shorter) are ordered by
how often they occur in the whole corpus. Exact containment is asked for, so
the prefix that a matching document must share is one shingle: the rarest. A
scan of the documents looks up these prefix shingles, bounds candidates by
length and position, screens them by a hash of the window at its place, and
verifies the words of the whole window.

The benchmark is the stated query set. One scan counts its shingles in the corpus
(a bit map of bounded size says which may be asked for; counts are joined exactly).
Its windows are cut into blocks of about BLOCK_WINDOWS, each broadcast on its own;
a task holds one block at a time and passes each batch of documents by all of
them, parting its words once. Documents are never shuffled.

Defined results: null text has no words and is clean; an item without words is
ignored; null item ids are ignored; a null doc_id stays null; repeated rows are
judged one by one; empty tables give empty or clean results; other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import arrays as A
from sigloom.llm.lookup import Lookup
from sigloom.llm.store import Kept

WINDOW = 13
SHINGLE = 5
BLOCK_WINDOWS = 200_000
MAP_BITS = 23  # of the bit map of shingles, at most
FLUSH = 1 << 20  # counted shingles that a task holds
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class _Words:
    """A piece's lower-cased words: hashes, byte spans, rows' offsets into them."""

    def __init__(self, buf, offs):
        self.low = A.LOWER[buf]
        self.starts, self.ends, self.rows = A.word_spans(self.low, offs, A.ALNUM)
        self.hashes = A.word_hash(self.low, self.starts, self.ends)
        self.sums = A.prefix_sums(self.hashes, 2)

    def __len__(self) -> int:
        return len(self.hashes)

    def shingles(self, k: int) -> np.ndarray:
        """Hashes of the k words from each place, to the piece's end."""
        return A.window_hash(self.sums, k, 2)

    def inside(self, k: int) -> np.ndarray:
        """Which of them stay in their document."""
        return A.starts_in_row(self.rows, k)[: max(0, len(self) - k + 1)]

    def text(self, a: int, b: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))


@A.giving_back
def _item_windows(batches):
    """One row per window of an item: its words, their number, hash and shingles."""
    names = ("item", "words", "size", "k", "hash", "shingles")
    schema = pa.schema(list(zip(names, (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))))
    for batch in batches:
        ids = batch.column("item_id").cast(pa.string())
        for first, last, buf, offs in A.pieces(batch):
            w = _Words(buf, offs)
            out = {k: [] for k in names}
            for r in range(last - first):
                a, b = int(w.rows[r]), int(w.rows[r + 1])
                size = min(WINDOW, b - a)
                if size == 0 or not ids[first + r].is_valid:
                    continue
                k = min(SHINGLE, size)
                for p in range(a, b - size + 1):
                    q = np.arange(p, p + size - k + 1)
                    row = (ids[first + r].as_py(), w.text(p, p + size), size, k, int(A.span_hash(w.sums, np.array([p]), np.array([p + size]), 2).view(np.int64)[0]), A.span_hash(w.sums, q, q + k, 2).view(np.int64).tolist())
                    for c, v in zip(out.values(), row):
                        c.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)


def _count_shingles(screen):
    """(shingle, n) of the documents' shingles that the bit map holds, summed up."""

    def rows(held: list) -> pa.RecordBatch:
        keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        keys, at = np.unique(keys, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, n, len(keys)).astype(np.int64))], ["shingle", "n"])

    @A.giving_back
    def run(batches):
        sizes, bits = screen.value
        mask, held, n = A.U64(len(bits) - 1), [], 0
        for batch in batches:
            for _, _, buf, offs in A.pieces(batch):
                w = _Words(buf, offs)
                for k in sizes:
                    h = w.shingles(k)[w.inside(k)]
                    held.append(np.unique(h[bits[(h & mask).astype(np.int64)]], return_counts=True))
                    n += len(held[-1][0])
                if n > FLUSH:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    return run


def _load(block):
    """A broadcast's value without the worker keeping it."""
    path = getattr(block, "_path", None)
    return block.load_from_path(path) if path else block.value


def _scan(blocks, drop: bool = False):
    """Judges documents against every block; gives the verdicts or, with drop, the
    rows that pass, with all their columns."""

    def judged(batches):
        """Each batch with pieces of it and their hits. A single block is at hand for
        one piece after another; of several each is loaded once for a whole batch."""
        one = _Block(blocks[0].value) if len(blocks) == 1 else None
        for batch in batches:
            pieces = A.pieces(batch)
            for some in ([p] for p in pieces) if one else [list(pieces)]:
                parts = [(first, last, _Words(buf, offs), []) for first, last, buf, offs in some]
                for b in blocks:
                    index = one or _Block(_load(b))
                    for _, _, w, hits in parts:
                        hits.append(index.match(w))
                yield batch, parts

    @A.giving_back
    def run(batches):
        for batch, parts in judged(batches):
            for first, last, w, hits in parts:
                starts, ends = (np.concatenate([h[k] for h in hits]) if hits else np.empty(0, np.int64) for k in (0, 1))
                hit = A.cover(len(w), starts, ends)
                n_words, n_hit = np.diff(w.rows), np.diff(np.concatenate([[0], np.cumsum(hit)])[w.rows])
                contaminated = (n_hit > 0) & (20 * n_hit >= n_words)
                if drop:
                    yield batch.slice(first, last - first).filter(pa.array(~contaminated))
                    continue
                found: dict[int, set[str]] = {}
                for h in hits:
                    for d, items in h[2]:
                        found.setdefault(d, set()).update(items)
                names = [sorted(found.get(d, ())) for d in range(last - first)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first).cast(pa.int64()),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                        pa.array(contaminated),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return run


class _Block:
    """The inverted index of one block: prefix shingle -> windows."""

    def __init__(self, w: dict):
        self.w = w
        self.index = []
        for k in np.unique(w["k"]):
            rows = np.flatnonzero(w["k"] == k)
            keys = w["prefix"][rows].view(A.U64)
            order = np.argsort(keys, kind="stable")
            look = Lookup(keys)
            bounds = np.searchsorted(keys[order], look.keys, side="left")
            self.index.append((int(k), look, rows[order], np.append(bounds, len(rows))))

    def match(self, words: _Words):
        """First and end words of the occurrences of windows, and (document, items)
        of each document and window that occurs in it."""
        w, rows = self.w, words.rows
        starts, ends, pairs = [np.empty(0, np.int64)], [np.empty(0, np.int64)], set()
        for k, look, listed, bounds in self.index:
            if len(words) < k:
                continue
            at, key = look.find(words.shingles(k))
            ok = words.inside(k)[at]
            at, key = at[ok], key[ok]
            size = bounds[key + 1] - bounds[key]
            pos = np.repeat(at, size)
            within = np.arange(len(pos)) - np.repeat(np.cumsum(size) - size, size)
            win = listed[np.repeat(bounds[key], size) + within]
            # Length and position: the whole window must lie in the document.
            start = pos - w["at"][win]
            end = start + w["size"][win]
            doc = np.searchsorted(rows, pos, side="right") - 1
            fits = (start >= rows[doc]) & (end <= rows[doc + 1])
            start, end, win, doc = start[fits], end[fits], win[fits], doc[fits]
            same = A.span_hash(words.sums, start, end, 2).view(np.int64) == w["hash"][win]
            start, end, win, doc = start[same], end[same], win[same], doc[same]
            same = np.array([words.text(a, b) == w["words"][x] for a, b, x in zip(start.tolist(), end.tolist(), win.tolist())], dtype=bool)
            starts.append(start[same])
            ends.append(end[same])
            pairs.update(zip(doc[same].tolist(), win[same].tolist()))
        return np.concatenate(starts), np.concatenate(ends), [(d, w["items"][x]) for d, x in pairs]


def _blocks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_windows: int) -> list:
    """Broadcasts of the benchmark's windows, block_windows or so in each, with the
    rarest shingle of each window (the smaller hash of equals) and its place."""
    windows = (
        benchmark.select("item_id", "text")
        .mapInArrow(_item_windows, "item string, words binary, size int, k int, hash long, shingles array<long>")
        .groupBy("words", "size", "k", "hash", "shingles")
        .agg(F.collect_set("item").alias("items"))
    )
    kept = Kept(windows, "windows")
    one = kept.df.select("k", "words", "size", F.posexplode("shingles").alias("at", "shingle"))
    n = kept.df.count()
    bits = min(MAP_BITS, max(16, (n * (WINDOW - SHINGLE + 1)).bit_length() + 3))
    screen = np.zeros(1 << bits, dtype=bool)
    slots = one.select(F.expr(f"shingle & {(1 << bits) - 1}").alias("s")).distinct().toArrow()
    screen[slots.column("s").to_numpy()] = True
    sizes = [r["k"] for r in kept.df.select("k").distinct().collect()]
    known = spark.sparkContext.broadcast((sizes, screen))
    counts = docs.select("text").mapInArrow(_count_shingles(known), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rarest = one.join(counts, "shingle", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("p"))
    chosen = Kept(kept.df.join(rarest, "words").select("words", "size", "k", "hash", "items", "p.shingle", "p.at"), "prefixes")
    kept.drop()
    blocks = max(1, -(-n // block_windows))
    # By hash: a block's size doesn't depend on the total. One at a time on the driver.
    parts = (chosen.df.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).toPandas() for b in range(blocks))
    out = [spark.sparkContext.broadcast(_arrays(part)) for part in parts]
    chosen.drop()
    return out


def _arrays(part) -> dict:
    longs = {c: part[c].to_numpy(np.int64) for c in ("size", "k", "hash", "at")}
    return longs | {"prefix": part["shingle"].to_numpy(np.int64), "words": [bytes(x) for x in part["words"]], "items": [list(x) for x in part["items"]]}


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_scan(_blocks(spark, docs, benchmark, block_windows)), _RESULT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows that the contamination rule leaves, columns unchanged. Rows are
    judged where they stand, so neither repeated nor null ids matter."""
    return docs.mapInArrow(_scan(_blocks(spark, docs, benchmark, block_windows), drop=True), docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op10_decontaminate": op10_decontaminate}

_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES = {
    "op10_decontaminate": f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT item, least(len(w), {WINDOW}) AS size, unnest(list_transform(range(1, len(w) - least(len(w), {WINDOW}) + 2),
    lambda p: array_to_string(list_slice(w, p, p + least(len(w), {WINDOW}) - 1), ' '))) AS g FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM x),
dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p, w FROM d, sizes WHERE len(w) >= size),
g AS (SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS g FROM dw),
m AS (SELECT g.doc_id, g.p, g.size, x.item FROM g JOIN x ON g.g = x.g AND g.size = x.size),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM m) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
}
