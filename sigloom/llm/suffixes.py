"""Suffix sorting by a difference cover modulo 3, in vectorised steps."""

from __future__ import annotations

import numpy as np


def _pack(*columns: np.ndarray) -> np.ndarray:
    """One integer for each row of columns, in the rows' order."""
    out = columns[0].astype(np.int64)
    top = int(out.max()) + 1 if len(out) else 1
    for c in columns[1:]:
        width = int(c.max()) + 1 if len(c) else 1
        if top * width >= 1 << 62:
            values, out = np.unique(out, return_inverse=True)
            top = len(values)
        out = out * width + c
        top *= width
    return out


def _merge_keys(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of two sets of rows, comparable with each other."""
    both = _pack(*(np.concatenate(x) for x in zip(a, b)))
    return both[: len(a[0])], both[len(a[0]) :]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; a suffix comes before its extensions.

    text: non-negative integers. Suffixes at places not divisible by 3 are sorted
    by their first three symbols; where that leaves ties, the triples' names form
    a text of two thirds of the length, which is sorted in turn. The others
    follow from their first symbol and the rank after it, and both are merged.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), dtype=np.int64)
    s = np.concatenate([text.astype(np.int64) + 1, np.zeros(4, np.int64)])
    # A text whose length is 1 modulo 3 gets one empty suffix into the sample, so
    # that names of places 1 and of places 2 modulo 3 don't run into each other.
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    key = _pack(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(key)
    new = np.empty(len(order), dtype=np.int64)
    new[0] = 0
    new[1:] = key[order][1:] != key[order][:-1]
    names = np.empty(len(order), dtype=np.int64)
    names[order] = np.cumsum(new)
    if names.max() + 1 < len(names):
        order = suffix_array(names)
    sorted_sample = sample[order]
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[sorted_sample] = np.arange(1, len(order) + 1)
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_pack(s[zero], rank[zero + 1]))]
    sorted_sample = sorted_sample[sorted_sample < n]
    first, second = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    a, b = _merge_keys([s[zero], rank[zero + 1]], [s[first], rank[first + 1]])
    before = np.searchsorted(b, a)
    a, b = _merge_keys([s[zero], s[zero + 1], rank[zero + 2]], [s[second], s[second + 1], rank[second + 2]])
    before += np.searchsorted(b, a)
    out = np.empty(n, dtype=np.int64)
    place = before + np.arange(len(zero))
    out[place] = zero
    rest = np.ones(n, dtype=bool)
    rest[place] = False
    out[rest] = sorted_sample
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order: whether each has `length` symbols in common with the
    one before. All of them must have that many."""
    same = np.zeros(len(starts), dtype=bool)
    left = np.arange(1, len(starts))
    for k in range(length):
        if not len(left):
            break
        left = left[text[starts[left] + k] == text[starts[left - 1] + k]]
    same[left] = True
    return same
