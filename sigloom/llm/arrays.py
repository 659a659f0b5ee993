"""Vectorised byte, word and window arithmetic on Arrow text columns.

Texts are handled as UTF-8 bytes in pieces of bounded size (one document may
exceed the bound; memory then follows that document). Words are hashed from
their bytes, eight at a time, by avalanche steps. Windows of many items have
polynomials modulo 2**64 over the items' random values; those can collide on
made-up regular sequences, so they only lead to candidates, whose items are then
compared. All are equal on equal content wherever it stands, on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
PIECE_BYTES = 2 << 20


def giving_back(run: Callable) -> Callable:
    """A function for mapInArrow that ends by giving back the memory that its
    allocators keep for nothing. Spark keeps a worker between tasks and stages, in
    an executor whose JVM keeps its heap as well."""

    @wraps(run)
    def task(batches, *args, **kwargs):
        try:
            yield from run(batches, *args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


def codes(seed: int, n: int = 256) -> np.ndarray:
    """n pseudo-random 64-bit codes made from a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, dtype=U64)

    def _grow(self, old: np.ndarray, base: int, n: int) -> np.ndarray:
        if len(old) >= n:
            return old
        steps = np.full(max(n, 2 * len(old)), base, dtype=U64)
        steps[0] = 1
        return np.cumprod(steps, dtype=U64)

    def up(self, n: int) -> np.ndarray:
        self._up = self._grow(self._up, self.base, n)
        return self._up[:n]

    def down(self, n: int) -> np.ndarray:
        self._down = self._grow(self._down, self.inverse, n)
        return self._down[:n]


_POWERS = {1: Powers(0x9E3779B97F4A7C15), 2: Powers(0xD6E8FEB86659FD93), 3: Powers(0xA0761D6478BD642F)}
_BYTE_CODES = {s: codes(s) for s in _POWERS}


def prefix_sums(values: np.ndarray, seed: int = 1) -> np.ndarray:
    """Prefix sums of value[i] * base**i, one longer than the input."""
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values * _POWERS[seed].up(len(values)), dtype=U64, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of each span [start, end) from prefix sums; spans of one content are equal."""
    return mix((sums[end] - sums[start]) * _POWERS[seed].down(len(sums))[start] + (end - start).astype(U64))


def window_hash(sums: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of every window of the length, by its start."""
    n = len(sums) - length
    if n <= 0:
        return np.empty(0, dtype=U64)
    return mix((sums[length:] - sums[:n]) * _POWERS[seed].down(n) + U64(length))


_LONG = 64  # bytes; longer words are hashed one by one


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """Hash of each span's bytes. Up to eight bytes, spans of one length that differ
    have different hashes."""
    size = ends - starts
    h = mix(size.astype(U64) + U64(seed << 32))
    if not len(h):
        return h
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    live, at = slice(None), 0
    while at < _LONG:
        left = size[live] - at
        part = eight[np.minimum(starts[live] + at, len(buf))]
        short = np.minimum(left, 8).clip(0).astype(U64) * U64(8)
        part = np.where(left < 8, part & ((U64(1) << (short & U64(63))) - U64(1)), part)
        h[live] = mix(h[live] ^ part * U64(0x9E3779B97F4A7C15))
        at += 8
        live = np.flatnonzero(size > at) if at == 8 else live[size[live] > at]
        if not len(live):
            return h
    for i in live.tolist():
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed)
    return h


def byte_sums(buf: np.ndarray, seed: int = 1) -> np.ndarray:
    return prefix_sums(_BYTE_CODES[seed][buf], seed)


def byte_table(*, word: str) -> np.ndarray:
    """Which bytes belong to words. 'blank': all but 0x20 and 0x09-0x0D;
    'alnum': ASCII digits and letters and every byte of other code points."""
    t = np.zeros(256, dtype=bool)
    if word == "blank":
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = True
        t[0x80:] = True
    return t


BLANK, ALNUM = byte_table(word="blank"), byte_table(word="alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, last) with their bytes and the row offsets into them;
    null texts are empty."""
    col = batch.column(column).cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(col):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, side="right")) - 1)
        part = offs[first : last + 1]
        yield first, last, buf[part[0] : part[-1]], part - part[0]
        first = last


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and each row's offset into them; rows split words."""
    m = table[buf]
    before = np.empty_like(m)
    before[1:] = m[:-1]
    after = np.empty_like(m)
    after[:-1] = m[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    before[full] = False
    after[offs[1:][offs[1:] > offs[:-1]] - 1] = False
    starts = np.flatnonzero(m & ~before)
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def row_of(offsets: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n items, given the rows' offsets into the items."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]


def starts_in_row(offsets: np.ndarray, length: int) -> np.ndarray:
    """Mask over items: a window of the length that starts here stays in its row."""
    n = int(offsets[-1])
    ok = np.zeros(n, dtype=bool)
    if n:
        left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
        ok = left >= length
    return ok


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the items in any of the spans."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
