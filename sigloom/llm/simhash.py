"""Near-duplicates by SimHash with pigeonring filtering.

Fingerprints: 64 bits over XXH64 (seed 42) of lower-cased word shingles. Links
join fingerprints that differ in at most 3 bits.

Filter. The 64 bits are a ring of 7 segments. If two fingerprints differ in at
most 3 bits, then for some segment i every chain i, i+1, ..., i+l-1 differs in
at most floor(3 l / 7) bits: 0, 0, 1, 1, 2, 2, 3 for l = 1..7. So segments i and
i+1 agree, at most one of the next two differs, and at most two of the next
four. That leaves five choices of two further equal segments for each of the 7
starts: 35 exact keys of 36 bits or more that together miss no pair. Rows that
meet under a key are tested chain by chain before the full Hamming distance.

Only distinct fingerprints are compared, so a group of exact copies is one row.
Within a key's bucket links are found by search from a pivot over the rows not
reached yet: at most one link per row leaves a bucket, never all its pairs. A
bucket above BUCKET rows is left and dealt out by more bits: of the bits that its
key leaves free four parts are made, one of which two linked rows must have in
common (they differ in three bits at most). Each round asks for a quarter of the
free bits more; when 11 or fewer are free, a bucket has 2,048 fingerprints at most,
so the rounds end, and no row is ever paired with a whole bucket. Components come
from star contraction.

Defined results: null or blank text has fingerprint zero, linked like any
other; component_id is the smallest doc_id, null ids not counted (all null:
null); a text's repeated rows are one fingerprint; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm import arrays as A
from sigloom.llm.components import roots
from sigloom.llm.names import fresh
from sigloom.llm.store import Kept, files_for, partitions_for

SHINGLE, SEED, DISTANCE = 3, 42, 3
BUCKET = 2048
FEW = 11  # free bits; with so many a bucket can't grow above 2,048
_WIDTHS = (9, 9, 9, 9, 9, 9, 10)
_EDGES = np.concatenate([[0], np.cumsum(_WIDTHS)])
_SEGMENTS = [((1 << w) - 1) << int(s) for w, s in zip(_WIDTHS, _EDGES)]
_RING = len(_SEGMENTS)


def _chain(i: int, offsets) -> int:
    return sum(_SEGMENTS[(i + k) % _RING] for k in offsets)


#: The 35 keys: (start, mask of the segments that must agree).
KEYS = [(i, _chain(i, (0, 1, *more))) for i in range(_RING) for more in ((2, 3), (2, 4), (2, 5), (3, 4), (3, 5))]
#: By start: (mask of a chain, bits it may differ in), longest last.
CHAINS = [[(np.uint64(_chain(i, range(n))), DISTANCE * n // _RING) for n in (4, 6)] for i in range(_RING)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _free_parts(mask: int) -> list[int]:
    """The bits that a key leaves free, in four parts."""
    free = [1 << b for b in range(64) if not mask >> b & 1]
    return [sum(free[k::4]) for k in range(4)]


@cache
def mask_of(number: int) -> int:
    """The bits of a key by its number: those of KEYS, then a part of the free ones
    for each further digit (to base 4, from 1)."""
    mask, rest = KEYS[number % len(KEYS)][1], number // len(KEYS)
    digits = []
    while rest:
        rest -= 1
        digits.append(rest % 4)
        rest //= 4
    for d in reversed(digits):
        mask |= _free_parts(mask)[d]
    return mask


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one text's UTF-8 bytes; 0 without words."""
    words = raw.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    h = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(seed))), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _with_fingerprint(names: list[str], own: str):
    """The named columns of each row and its fingerprint as `own`."""

    @A.giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for first, last, buf, offs in A.pieces(batch):
                whole = buf.tobytes()
                fps += [fingerprint(whole[offs[k] : offs[k + 1]]) for k in range(last - first)]
            yield batch.select(names).append_column(own, pa.array(np.array(fps, np.uint64).view(np.int64)))

    return run


def fingerprints(docs: DataFrame, names: list[str], own: str = "fp") -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(own, T.LongType())])
    return docs.mapInArrow(_with_fingerprint(names, own), schema)


def _spanning(fps: np.ndarray, start: int) -> tuple[list, list]:
    """Links that connect whatever is connected within the bucket."""
    left, to, rest = [], [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            v = queue.pop()
            diff = rest ^ v
            near = np.ones(len(rest), dtype=bool)
            for mask, most in CHAINS[start]:
                near &= np.bitwise_count(diff & mask) <= most
            near[near] = np.bitwise_count(diff[near]) <= DISTANCE
            if near.any():
                hits = rest[near]
                left += [v] * len(hits)
                to += hits.tolist()
                queue += list(hits)
                rest = rest[~near]
    return left, to


def _most(number: int, bucket: int) -> int:
    """Rows of a bucket that are compared as they are."""
    return bucket if mask_of(number).bit_count() < 64 - FEW else max(bucket, 1 << FEW)


@A.giving_back
def _bucket_links(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, part, fp) sorted by (k, part): links (fp, other) of each bucket; of
    a bucket above the size, its rows themselves. The key's number is k modulo the
    number of KEYS; higher digits tell the parts that later rounds asked for."""

    def out(a, b, k=None, part=None):
        n = len(a)
        col = lambda x, t: pa.nulls(n, t) if x is None else pa.array(np.full(n, x), t)
        to = pa.nulls(n, pa.int64()) if b is None else pa.array(np.asarray(b, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), to, col(k, pa.int32()), col(part, pa.int64())], ["a", "b", "k", "part"])

    held, hot = None, None
    def runs(last: bool):
        """Takes the complete buckets out of `held`."""
        nonlocal held, hot
        k, part, fp = held
        new = np.flatnonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1])) + 1
        begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(k)]])
        if not last:
            begin, end, tail = begin[:-1], end[:-1], int(begin[-1])
        size = end - begin
        if hot is not None and len(begin) and (k[0], part[0]) == hot:
            yield out(fp[: end[0]], None, *hot)
            begin, end, size = begin[1:], end[1:], size[1:]
        two = begin[size == 2]
        x = fp[two] ^ fp[two + 1]
        good = np.bitwise_count(x) <= DISTANCE
        for start in range(_RING):
            mine = np.isin(k[two] % len(KEYS), [n for n, (i, _) in enumerate(KEYS) if i == start])
            for mask, most in CHAINS[start]:
                good[mine] &= np.bitwise_count(x[mine] & mask) <= most
        a, b = [fp[two[good]]], [fp[two[good] + 1]]
        for s, e in zip(begin[size > 2].tolist(), end[size > 2].tolist()):
            if e - s > _most(int(k[s]), bucket):
                yield out(fp[s:e], None, k[s], part[s])
                continue
            p, q = _spanning(fp[s:e], KEYS[k[s] % len(KEYS)][0])
            if p:
                a.append(np.array(p, np.uint64))
                b.append(np.array(q, np.uint64))
        yield out(np.concatenate(a), np.concatenate(b))
        if last:
            held = None
            return
        held = tuple(c[tail:] for c in held)
        if hot is not None and (held[0][0], held[1][0]) != hot:
            hot = None
        if len(held[0]) > _most(int(held[0][0]), bucket):  # it goes on, but what is here need not be kept
            hot = (held[0][0], held[1][0])
            yield out(held[2][:-1], None, *hot)
            held = tuple(c[-1:] for c in held)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = (batch.column("k").to_numpy(), batch.column("part").to_numpy(), batch.column("fp").to_numpy().view(np.uint64))
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
        yield from runs(False)
    if held is not None:
        yield from runs(True)


def _deeper(number: int) -> list[int]:
    """The numbers of the four keys that a key is dealt out by."""
    return [number % len(KEYS) + len(KEYS) * (4 * (number // len(KEYS)) + d + 1) for d in range(4)]


def _linked(rows: DataFrame, bucket: int) -> DataFrame:
    """rows: k, part, fp."""
    n = partitions_for(rows)
    dealt = rows.repartition(n, "k", "part").sortWithinPartitions("k", "part").select("k", "part", "fp")
    return dealt.mapInArrow(partial(_bucket_links, bucket=bucket), "a long, b long, k int, part long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) over distinct fingerprints `fp`: links at distance 3 or less that
    connect all that are connected; and the rows of buckets above the size (b null)."""
    masks = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for _, m in KEYS))
    return _linked(fps.select("fp", F.posexplode(masks).alias("k", "part")), bucket)


def link_table(fps: DataFrame, bucket: int = BUCKET) -> Kept:
    """links(), written, with the buckets above the size dealt out by more bits. What
    the tasks find is little: it goes in a file for each MB of fingerprints."""
    n = files_for(fps, 1 << 20)
    table = Kept(links(fps, bucket).repartition(n), "links")
    left, done = table, [table]
    while True:
        hot = left.df.filter("b IS NULL").select("k", "part", F.col("a").alias("fp"))
        numbers = [r["k"] for r in hot.select("k").distinct().collect()]
        numbers.sort()
        if not numbers:
            break
        deeper = {n: [(m, _signed(mask_of(m))) for m in _deeper(n)] for n in numbers}
        pick = F.create_map(*(x for n, to in deeper.items() for x in (F.lit(n), F.array(*(F.struct(F.lit(m).alias("k"), F.lit(mask).alias("mask")) for m, mask in to)))))
        dealt = hot.select("fp", F.explode(F.element_at(pick, F.col("k"))).alias("to")).select("fp", F.col("to.k").alias("k"), F.col("fp").bitwiseAND(F.col("to.mask")).alias("part")).distinct()
        left = Kept(_linked(dealt, bucket).repartition(max(n, files_for(hot))), "links")
        done.append(left)
    if len(done) == 1:
        return table
    both = Kept(reduce(DataFrame.union, [t.df for t in done]).filter("b IS NOT NULL"), "links")
    for t in done:
        t.drop()
    return both


def groups(docs: DataFrame) -> tuple[Kept, DataFrame]:
    """The documents' fingerprints (doc_id, fp), written, and (fp, root,
    component_id) for each distinct fingerprint."""
    sig = Kept(fingerprints(docs.select("doc_id", "text"), ["doc_id"]), "fingerprints")
    fps = sig.df.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = link_table(fps.select("fp"))
    star = roots(found.df.filter("b IS NOT NULL").select("a", "b"))
    found.drop()
    rooted = fps.join(star.df.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "low", F.coalesce("v", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    # Dealt by root here, so that a join on fp deals both sides anew: only then does
    # adaptive execution split the rows of a much copied text.
    return sig, rooted.join(lowest.hint("merge"), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row."""
    sig, comp = groups(docs)
    return sig.df.join(comp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _one_row(df: DataFrame, key: str) -> DataFrame:
    """One row of each key: the one whose text has the smallest hash, then by its
    other columns. Partial results are merged before the shuffle."""
    rest = F.to_json(F.struct(*(F.col(c) for c in df.columns if c.lower() != "text")))
    first = F.min_by(F.struct(*df.columns), F.struct(F.xxhash64("text"), rest))
    return df.groupBy(F.col(key).alias("key")).agg(first.alias("row")).select("row.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group left: the smallest doc_id, one row of it
    (where it has several texts in the group, the one with the smallest hash). Rows
    without an id stay only where no row of the group has one, and then one does."""
    sig, comp = groups(docs)
    fp, root, low = fresh(docs, "fp"), fresh(docs, "root"), fresh(docs, "low")
    named = comp.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(low))
    rooted = sig.df.filter("doc_id IS NOT NULL").join(comp, "fp").groupBy("doc_id")
    split = Kept(rooted.agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("doc_id"), "split").df
    winners = comp.filter("component_id IS NOT NULL").select(F.col("component_id").alias("doc_id")).distinct()
    kept = docs.join(winners, "doc_id", "left_semi").join(split, "doc_id", "left_anti")
    kept = _one_row(kept, "doc_id")
    if not split.isEmpty():  # ids with texts of several groups, each judged in its own
        marked = fingerprints(docs.join(split, "doc_id", "left_semi").select(docs.columns), docs.columns, fp)
        own = _one_row(marked.join(named, fp).filter(F.col("doc_id") == F.col(low)), root)
        kept = kept.unionByName(own.drop(fp, root, low))
    if sig.df.filter("doc_id IS NULL").isEmpty():
        return kept
    marked = fingerprints(docs.filter("doc_id IS NULL"), docs.columns, fp)
    alone = comp.filter("component_id IS NULL").select(F.col("fp").alias(fp), F.col("root").alias(root))
    return kept.unionByName(_one_row(marked.join(alone, fp), root).drop(fp, root))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_simhash": op7_simhash}
