"""Repeats of long windows: each window is routed to an index that decides.

Items are bytes or words; a window is `length` consecutive items of one document.
Every window has an anchor: the smallest hash of the grams (`gram` items) inside
it, the leftmost of equals. Equal windows have equal anchors at equal places, so
a window can only repeat where its anchor does, and all copies of a window meet
under one anchor. The windows in a row with one anchor are a context. Anchors and
hashes only say which shard a window goes to; whether it repeats is decided there
by the caller's index (suffix array, FM-index) on the items themselves.

1. `gather` scans the documents and finds the anchors that stand in two places or
   more. A task sends each anchor once, so a hot one costs a row for each flush.
2. The contexts of those anchors are cut out of their documents and dealt out by
   anchor. A task sends equal contents once, with their first and last place; places
   between them go their own way, to no shard in particular.
3. A shard's index holds its different contents, each with its first and last place,
   and decides which windows of the first one go and which of the later ones. The
   contents of an anchor asked for more than BUSY times (the edge of a very common
   passage) are merged by content first, and then dealt out by whole windows.
4. Runs of windows of first and last places are ready then; the verdict for the places
   between is joined to them (adaptive execution splits what is hot). `marked` joins
   the runs back to the documents.

A document is told by its id and a hash of its text, so rows with one id and
different texts are different documents and repeated rows are the same one (all
its rows get its result). A null id comes before all others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import arrays as A
from sigloom.llm.store import Kept, free_shuffles, partitions_for

NO_ID = -(1 << 63)
FLUSH = 1 << 17  # contexts that a task holds before it deals them out
#: The contents of anchors asked for more often than this are dealt out by whole windows.
BUSY = 20_000
BROADCAST = 1_000_000  # busy anchors, 16 bytes each
_PLACE = A.U64((1 << 32) - 1)

ENTRY = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("text", "<i4"), ("start", "<u4"), ("n", "<u2"), ("asked", "u1")])


@dataclass(frozen=True)
class Shape:
    """How documents become items, and which repeats are looked for.

    items: (bytes, row offsets) -> (64-bit value of each item, rows' offsets)
    cutter: (bytes, row offsets) -> a function that gives items a..b as bytes
    windows: (content, n) -> the bytes of its n windows"""

    items: Callable
    cutter: Callable
    windows: Callable
    length: int
    gram: int
    piece: int = A.PIECE_BYTES  # bytes handled at once; about 100 times that in memory for byte items

    @property
    def reach(self) -> int:
        """Grams of a window."""
        return self.length - self.gram + 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchor_runs(values: np.ndarray, rows: np.ndarray, shape: Shape):
    """The contexts of a piece: anchor, place and number of windows, document's row."""
    none = np.empty(0, np.int64)
    if len(values) < shape.length:
        return none.view(np.uint64), none, none, none
    hashes = A.window_hash(A.prefix_sums(values, 2), shape.gram, 2)
    # The order of hashes that agree in their upper half is that of their places.
    low = sliding_min((hashes & ~_PLACE) | np.arange(len(hashes), dtype=A.U64), shape.reach)
    at = (low & _PLACE).astype(np.int64)
    inside = A.starts_in_row(rows, shape.length)[: len(at)]
    turn = at[1:] != at[:-1]
    start, stop = inside.copy(), inside.copy()
    start[1:] &= turn | ~inside[:-1]
    stop[:-1] &= turn | ~inside[1:]
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    return hashes[at[first]], first, last - first + 1, np.searchsorted(rows, first, side="right") - 1


def _as_before(e: np.ndarray, *names: str) -> np.ndarray:
    """Of entries in order, the mask of those equal to the one before."""
    same = np.zeros(len(e), dtype=bool)
    same[1:] = True
    for c in names:
        same[1:] &= e[c][1:] == e[c][:-1]
    return same


def _in_groups(same: np.ndarray) -> np.ndarray:
    """Mask of the entries that equal a neighbour."""
    both = same.copy()
    both[:-1] |= same[1:]
    return both


def _deal(e: np.ndarray, shards: int) -> pa.RecordBatch:
    """One entry of each anchor, by shard (kind 0); where the flush has several, its
    anchor is known to repeat and all of them are asked for at once (kind 1)."""
    e = e[np.lexsort((e["start"], e["text"], e["doc"], e["anchor"]))]
    e = e[~_as_before(e, "anchor", "doc", "text", "start")]  # repeated rows of a document
    again = _as_before(e, "anchor")
    known = e[_in_groups(again)]
    e["asked"] = _in_groups(again)
    e = e[~again]
    # Anchors are minima, so their own values crowd at the low end; mixed they don't.
    bucket = ((A.mix(e["anchor"]) >> A.U64(32)) * A.U64(shards) >> A.U64(32)).astype(np.int64)
    turn = np.argsort(bucket, kind="stable")
    e, bucket = e[turn], bucket[turn]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    out = [(int(bucket[a]), 0, e[a:b].tobytes()) for a, b in zip([0, *cuts], [*cuts, len(e)])] if len(e) else []
    for a in range(0, len(known), 1 << 14):
        out.append((int(A.mix(known["anchor"][a : a + 1])[0]) % shards, 1, known[a : a + (1 << 14)].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "kind", "blob"])


def _scan(shape: Shape, shards: int):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, texts = batch.column("k").to_numpy(), batch.column("t").to_numpy()
            for first, _, buf, offs in A.pieces(batch, limit=shape.piece):
                values, rows = shape.items(buf, offs)
                anchor, at, count, row = anchor_runs(values, rows, shape)
                e = np.empty(len(at), dtype=ENTRY)
                e["anchor"], e["start"], e["n"], e["asked"] = anchor, at - rows[row], count, 0
                e["doc"], e["text"] = ids[first + row], texts[first + row]
                held.append(e)
                n += len(e)
                if n >= FLUSH:
                    yield _deal(np.concatenate(held), shards)
                    held, n = [], 0
        if n:
            yield _deal(np.concatenate(held), shards)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """k, t: what tells a document; and its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.hash("text").alias("t"), "text")


ASKED = "k long, t int, at long, anchor long"


def _asks(e: np.ndarray) -> pa.RecordBatch:
    """at: the first window and their number (below 2**16) in one value."""
    at = (e["start"].astype(np.int64) << 16) | e["n"].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(e["doc"]), pa.array(e["text"]), pa.array(at), pa.array(e["anchor"].view(np.int64) if len(e) else np.empty(0, np.int64))], ["k", "t", "at", "anchor"])


def _repeated(batches):
    """A shard's entries: those whose anchor stands elsewhere too."""
    held = []
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
            e = np.frombuffer(blob.as_buffer(), dtype=ENTRY)
            if kind:
                yield _asks(np.ascontiguousarray(e))
            else:
                held.append(e)
    if not held:
        return
    e = np.concatenate(held)
    held.clear()
    e = e[np.argsort(e["anchor"], kind="stable")]
    yield _asks(e[_in_groups(_as_before(e, "anchor")) & (e["asked"] == 0)])


def gather(docs: DataFrame, shape: Shape) -> Kept:
    """Step 1: ASKED rows, the contexts whose anchors stand in several places."""
    shards = partitions_for(docs, 24 << 20)
    dealt = keyed(docs).mapInArrow(_scan(shape, shards), "bucket int, kind int, blob binary")
    # Buckets are even by construction; hashing their numbers would pile some up.
    return Kept(dealt.repartitionById(shards, "bucket").mapInArrow(_repeated, ASKED), "asked")


def _spread(df: DataFrame, docs: DataFrame) -> DataFrame:
    """By document, in more partitions than the session's where its are too few."""
    n = partitions_for(docs)
    return df.repartition(n, "k", "t") if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: A content of a flush: route, first and last place, its windows, bytes, whether the
#: flush has places between, and whether its anchor is busy.
HEAD = np.dtype([("route", "<u8"), ("k", "<i8"), ("t", "<i4"), ("s", "<u4"), ("k2", "<i8"), ("t2", "<i4"), ("s2", "<u4"), ("n", "<u2"), ("size", "<u4"), ("more", "u1"), ("busy", "u1")])
#: A place between the first and the last of a content.
SPOT = np.dtype([("c1", "<i8"), ("c2", "<i8"), ("k", "<i8"), ("t", "<i4"), ("s", "<u4")])
_TYPES = {"route": pa.int64(), "kind": pa.int32(), "c1": pa.int64(), "c2": pa.int64(), "n": pa.int32(), "items": pa.binary(), "k": pa.int64(), "t": pa.int32(), "s": pa.int64(), "k2": pa.int64(), "t2": pa.int32(), "s2": pa.int64(), "off": pa.int32(), "first": pa.bool_()}


class _Out:
    """Rows of a schema, column by column."""

    def __init__(self, schema: str):
        self.names = [c.split()[0] for c in schema.split(", ")]
        self.columns: list[list] = [[] for _ in self.names]

    def add(self, *row) -> None:
        for c, v in zip(self.columns, row):
            c.append(v)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for c, n in zip(self.columns, self.names)], self.names)
        self.columns = [[] for _ in self.names]
        return out


def _rows_of(batch: pa.RecordBatch, schema: str):
    return zip(*(batch.column(c.split()[0]).to_pylist() for c in schema.split(", ")))


def _content_id(items: bytes) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(items)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _packed(found: dict, shards: int) -> pa.RecordBatch:
    """A flush's contents by shard (kind 0), and the places between (kind 1)."""
    pack = zstandard.ZstdCompressor(level=1).compress
    heads, contents, spots = np.empty(len(found), HEAD), list(found), []
    rows = []
    for items, (anchor, n, places) in found.items():
        lo, hi = min(places), max(places)
        busy = anchor is None
        rows.append(((xxhash.xxh64_intdigest(items) if busy else anchor), *lo, *hi, n, len(items), len(places) > 2, busy))
        if len(places) > 2:
            c1, c2 = _content_id(items)
            spots += [(c1, c2, *p) for p in places if p != lo and p != hi]
    heads[:] = rows
    bucket = ((A.mix(heads["route"]) >> A.U64(32)) * A.U64(shards) >> A.U64(32)).astype(np.int64)
    turn = np.argsort(bucket, kind="stable")
    heads, bucket = heads[turn], bucket[turn]
    contents = [contents[i] for i in turn.tolist()]
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    out = [(int(bucket[a]), 0, b - a, pack(heads[a:b].tobytes() + b"".join(contents[a:b]))) for a, b in zip(edges[:-1], edges[1:])] if len(bucket) else []
    for a in range(0, len(spots), 1 << 14):
        some = np.array(spots[a : a + (1 << 14)], SPOT)
        out.append((int(A.mix(some["c1"][:1].view(A.U64))[0]) % shards, 1, len(some), pack(some.tobytes())))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.binary())], ["bucket", "kind", "rows", "blob"])


def _cut(shape: Shape, shards: int):
    def run(batches):
        found: dict = {}
        held = 0
        for batch in batches:
            ks, ts = batch.column("k").to_pylist(), batch.column("t").to_pylist()
            lists = batch.column("asks")
            for first, last, buf, offs in A.pieces(batch, limit=shape.piece):
                get, base = shape.cutter(buf, offs)
                for d in range(first, last):
                    own = lists[d].values
                    ats, anchors = own.field(0).to_pylist(), own.field(1).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
                    busy = own.field(2).to_pylist()
                    k, t, b = ks[d], ts[d], int(base[d - first])
                    for at, anchor, much in zip(ats, anchors, busy):
                        s, n = at >> 16, at & 0xFFFF
                        items = get(b + s, b + s + n + shape.length - 1)
                        had = found.get(items)
                        if had is None:
                            found[items] = (None if much else anchor, n, {(k, t, s)})
                        else:
                            had[2].add((k, t, s))
                    held += len(ats)
                if held >= FLUSH:
                    yield _packed(found, shards)
                    found, held = {}, 0
        if found:
            yield _packed(found, shards)

    return run


def cut(docs: DataFrame, asked: DataFrame, shape: Shape, shards: int, busy: int) -> DataFrame:
    """Step 2: contents and places between, packed by shard."""
    often = Kept(asked.groupBy("anchor").count().filter(F.col("count") > busy).select("anchor", F.lit(True).alias("busy")), "busy").df
    n = often.count()
    # As a rule a few; joined by a shuffle where they would be too many to send out.
    flagged = asked.join(F.broadcast(often) if n <= BROADCAST else often, "anchor", "left") if n else asked.withColumn("busy", F.lit(None).cast("boolean"))
    flagged = flagged.select("k", "t", "at", "anchor", F.col("busy").isNotNull().alias("busy"))
    lists = _spread(flagged, docs).groupBy("k", "t").agg(F.collect_list(F.struct("at", "anchor", "busy")).alias("asks"))
    return _spread(keyed(docs), docs).join(lists, ["k", "t"]).mapInArrow(_cut(shape, shards), "bucket int, kind int, rows int, blob binary")


@dataclass
class Content:
    """One of a shard's different contents, with its first and last place."""

    key: tuple
    n: int
    items: bytes
    lo: tuple
    hi: tuple
    more: bool = False  # it has places between them


#: What a shard leaves, by kind: RUN (k, t, s, n) of windows that go; REST, a run
#: (off, n) of a content's later places, with its first place; PLACE of a content
#: between its first and last; OPEN, a content of a busy anchor.
DECIDED = "kind int, c1 long, c2 long, n int, items binary, k long, t int, s long, k2 long, t2 int, s2 long, off int"
RUN, REST, PLACE, OPEN = range(4)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [(a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _judge(decide: Callable, shard: list[Content], out: _Out) -> None:
    for c, (one, rest) in zip(shard, decide(shard)):
        k, t, s = c.lo
        for off, n in _runs(one):
            out.add(RUN, None, None, n, None, k, t, s + off, None, None, None, None)
        if c.hi == c.lo:
            continue
        for off, n in _runs(rest):
            out.add(RUN, None, None, n, None, c.hi[0], c.hi[1], c.hi[2] + off, None, None, None, None)
            if c.more:
                out.add(REST, *_content_id(c.items), n, None, k, t, s, None, None, None, off)


def _unpacked(batches):
    """A shard's content rows (route, items, first, last, n, more, busy), unordered,
    and its places between, as lists."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows, spots = [], []
    for batch in batches:
        for kind, m, blob in zip(batch.column("kind").to_pylist(), batch.column("rows").to_pylist(), batch.column("blob")):
            raw = unpack(blob.as_py())
            if kind:
                spots.append(np.frombuffer(raw, SPOT))
                continue
            heads = np.frombuffer(raw, HEAD, m)
            at = np.concatenate([[0], np.cumsum(heads["size"], dtype=np.int64)]) + m * HEAD.itemsize
            at = at.tolist()
            for (route, k, t, s, k2, t2, s2, n, _, more, busy), a, b in zip(heads.tolist(), at, at[1:]):
                rows.append((route, raw[a:b], (k, t, s), (k2, t2, s2), n, more, busy))
    return rows, spots


def _decide(decide: Callable, limit: int):
    """decide: list of Content -> a pair of masks of each one's windows, for its
    first place and for the later ones."""

    def run(batches):
        out = _Out(DECIDED)
        rows, spots = _unpacked(batches)
        for some in spots:
            for c1, c2, k, t, s in some.tolist():
                out.add(PLACE, c1, c2, None, None, k, t, s, None, None, None, None)
            if len(out.columns[0]) > FLUSH:
                yield out.batch()
        rows.sort(key=lambda r: r[0])
        held: list[Content] = []  # of routes before this one
        own: dict = {}  # of this one
        size, before = 0, None
        for k in range(len(rows)):
            route, items, lo, hi, n, more, busy = rows[k]
            rows[k] = None
            if route != before:
                held += own.values()
                own, before = {}, route
                if size >= limit:
                    _judge(decide, held, out)
                    yield out.batch()
                    held, size = [], 0
            if busy:
                out.add(OPEN, *_content_id(items), n, items, *lo, *hi, None)
                continue
            had = own.get(items)
            if had is None:
                own[items] = Content((), n, items, lo, hi, bool(more))
                size += len(items)
                continue
            least, most = min(had.lo, lo), max(had.hi, hi)
            between = {had.lo, had.hi, lo, hi} - {least, most}
            if between:
                ids = _content_id(items)
                for place in between:
                    out.add(PLACE, *ids, None, None, *place, None, None, None, None)
            had.lo, had.hi, had.more = least, most, had.more or bool(more) or bool(between)
        held += own.values()
        if held:
            _judge(decide, held, out)
        yield out.batch()

    return run


VERDICT = "c1 long, c2 long, first boolean, k long, t int, s long, off int, n int"


def _window_hashes(shape: Shape):
    """(w, twice, c1, c2, off): the windows of hot contents."""

    def run(batches):
        for batch in batches:
            w, twice, c1, c2, off = [], [], [], [], []
            for a, b, n, items, many in zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "n", "items", "many"))):
                w += [xxhash.xxh64_intdigest(x) for x in shape.windows(items, n)]
                twice += [many] * n
                c1 += [a] * n
                c2 += [b] * n
                off += range(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(w, np.uint64).view(np.int64)), pa.array(twice, pa.bool_()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(off, pa.int32())], ["w", "twice", "c1", "c2", "off"])

    return run


#: A window of a hot content, as a content of its own: c1, c2, off tell it.
WINDOW = "route long, c1 long, c2 long, off int, items binary, k long, t int, s long, k2 long, t2 int, s2 long"


def _window_rows(shape: Shape):
    def run(batches):
        names = ("c1", "c2", "n", "items", "k", "t", "s", "k2", "t2", "s2", "offs")
        for batch in batches:
            out = _Out(WINDOW)
            for c1, c2, n, items, k, t, s, k2, t2, s2, offs in zip(*(batch.column(c).to_pylist() for c in names)):
                windows = shape.windows(items, n)
                for o in offs:
                    w = int(np.uint64(xxhash.xxh64_intdigest(windows[o])).view(np.int64))
                    out.add(w, c1, c2, o, windows[o], k, t, s + o, k2, t2, s2 + o)
            yield out.batch()

    return run


def _decide_windows(decide: Callable, limit: int):
    """As _decide, for single windows of such contents; VERDICT rows. Equal windows of
    different contents are one string with all their places."""

    def judged(held: list[Content]) -> pa.RecordBatch:
        strings: dict = {}
        for c in held:
            had = strings.setdefault(c.items, Content((), 1, c.items, c.lo, c.hi))
            had.lo, had.hi = min(had.lo, c.lo), max(had.hi, c.hi)
        verdict = {s: (bool(a.any()), bool(b.any()), v.lo) for (s, v), (a, b) in zip(strings.items(), decide(list(strings.values())))}
        out = _Out(VERDICT)
        for c in held:
            one, rest, lo = verdict[c.items]
            c1, c2, off = c.key
            # A content's own first place is the string's first one or a later one.
            for first, mark in ((True, one if c.lo == lo else rest), (False, rest)):
                if mark:
                    out.add(c1, c2, first, c.lo[0], c.lo[1], c.lo[2] - off, off, 1)
        return out.batch()

    def run(batches):
        held: list[Content] = []
        size, before = 0, None
        for batch in batches:
            for route, c1, c2, off, items, k, t, s, k2, t2, s2 in _rows_of(batch, WINDOW):
                if route != before and size >= limit:
                    yield judged(held)
                    held, size = [], 0
                before = route
                held.append(Content((c1, c2, off), 1, items, (k, t, s), (k2, t2, s2)))
                size += len(items)
        if held:
            yield judged(held)

    return run


def _open_verdicts(left: DataFrame, shards: int, shape: Shape, decide: Callable, limit: int) -> DataFrame:
    """VERDICT rows of the contents that busy anchors left open: their windows are
    dealt out each by itself. Those that no other window's hash equals go nowhere."""
    place = lambda f, *c: f(F.struct(*c))
    much = left.groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("items").alias("items"), place(F.min, "k", "t", "s").alias("lo"), place(F.max, "k2", "t2", "s2").alias("hi"))
    much = Kept(much.select("c1", "c2", "n", "items", "lo.*", "hi.*"), "hot").df
    many = ~(F.struct("k", "t", "s") == F.struct("k2", "t2", "s2"))
    hashes = Kept(much.select("c1", "c2", "n", "items", many.alias("many")).mapInArrow(_window_hashes(shape), "w long, twice boolean, c1 long, c2 long, off int"), "windows").df
    again = hashes.groupBy("w").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).filter("n > 1 OR twice").select("w")
    offs = hashes.join(again, "w").groupBy("c1", "c2").agg(F.collect_list("off").alias("offs"))
    windows = much.join(offs, ["c1", "c2"]).mapInArrow(_window_rows(shape), WINDOW)
    return windows.repartition(shards, "route").sortWithinPartitions("route").mapInArrow(_decide_windows(decide, limit), VERDICT)


def found_runs(docs: DataFrame, shape: Shape, decide: Callable, limit: int, busy: int = BUSY) -> DataFrame:
    """(k, t, start, n): the runs of windows that `decide` marks."""
    shards = partitions_for(docs, 24 << 20)
    asked = gather(docs, shape)
    free_shuffles(docs.sparkSession)
    decided = Kept(cut(docs, asked.df, shape, shards, busy).repartitionById(shards, "bucket").mapInArrow(_decide(decide, limit), DECIDED), "decided").df
    asked.drop()
    free_shuffles(docs.sparkSession)
    runs = decided.filter(F.col("kind") == RUN).select("k", "t", F.col("s").alias("start"), "n")
    place = lambda df, k, t, s: df.select("c1", "c2", F.col(k).alias("pk"), F.col(t).alias("pt"), F.col(s).alias("ps"))
    places = place(decided.filter(F.col("kind") == PLACE), "k", "t", "s")
    verdicts = decided.filter(F.col("kind") == REST).select("c1", "c2", F.lit(False).alias("first"), "k", "t", "s", "off", "n")
    left = decided.filter(F.col("kind") == OPEN)
    if not left.isEmpty():
        verdicts = verdicts.union(Kept(_open_verdicts(left, shards, shape, decide, limit), "verdicts").df)
        places = places.union(place(left, "k", "t", "s")).union(place(left, "k2", "t2", "s2"))
    own = F.struct("pk", "pt", "ps") == F.struct("k", "t", "s")
    more = places.join(verdicts, ["c1", "c2"]).filter(own == F.col("first"))
    return runs.union(more.select(F.col("pk").alias("k"), F.col("pt").alias("t"), (F.col("ps") + F.col("off")).alias("start"), "n"))


def marked(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Step 4: every row of docs with its runs (null if there are none) as `runs`."""
    per_doc = _spread(runs, docs).groupBy("k", "t").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return _spread(keyed(docs), docs).join(per_doc, ["k", "t"], "left").select("k", "text", "runs")
