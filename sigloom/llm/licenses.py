"""Licence scan: winnowed template fingerprints, then banded alignment.

Templates are normalised to lower-case words; of each run of WINNOW consecutive
5-word shingles the smallest hash is a fingerprint (the rightmost of equals), and
an inverted index maps fingerprints to (template, place). Templates below SHORT
words are indexed by a few rare words instead, of which each match holds one. A document that shares
a fingerprint with a template is aligned with it around each diagonal that the
shared fingerprints name: a global-in-template, local-in-document edit alignment
in a band of BAND words either side. Alignments that cover COVERAGE of the
template or more are reported with their spans in the document.

The templates are a parameter of bounded size (checked) and go out in one
broadcast; documents are scanned where they stand.

Defined results: null and blank texts match nothing and give no rows; a null
doc_id stays null; repeated rows are reported one by one; of overlapping
alignments of one template the one with the most matched words is kept (the
earlier of equals); an alignment inside one of another template with more matched
words (of equals, more coverage) is part of that text and gives no row, so a
BSD-3-Clause text is not reported as the shorter BSD-2-Clause; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import pkgutil
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import arrays as A
from sigloom.llm.lookup import Lookup

SHINGLE, WINNOW, BAND, COVERAGE = 5, 4, 8, 0.8
#: Templates below this many words are indexed by single words (see build).
SHORT = 20
#: Not chosen for that as long as there are others.
COMMON = frozenset("a as at by general in is it licensed of on or public released the this to under version work".split())
MAX_TEMPLATE_WORDS = 2_000_000

#: Notices and parts of licences by SPDX name.
NOTICES = {
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
}

_FSF = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
NOTICES |= {
    "AGPL-3.0": [_FSF.format("GNU Affero General Public License", ",", "3")],
    "GPL-2.0": [_FSF.format("GNU General Public License", ";", "2")],
    "LGPL-2.1": [_FSF.format("GNU Lesser General Public License", ";", "2.1")],
    "LGPL-3.0": [_FSF.format("GNU Lesser General Public License", ",", "3")],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
#: Creative Commons 4.0 by what the short and the long name add.
for _short, _long in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives")):
    NOTICES[f"CC-BY{_short}-4.0"] = [f"Licensed under CC BY{_short} 4.0.", f"This work is licensed under a Creative Commons Attribution{_long} 4.0 International License."]

#: Licences whose whole text is in license_texts/.
WHOLE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib")
#: Where the warranty part of a short licence begins; it is often quoted alone.
DISCLAIMERS = {"MIT": "THE SOFTWARE IS", "ISC": "THE SOFTWARE IS", "BSD-2-Clause": "THIS SOFTWARE IS"}


def _templates() -> dict[str, list[str]]:
    """Notices, whole texts and disclaimers by SPDX name."""
    out = {name: list(texts) for name, texts in NOTICES.items()}
    for name in WHOLE:
        text = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()
        out.setdefault(name, []).append(text)
        if name in DISCLAIMERS:
            out[name].append(text[text.index(DISCLAIMERS[name]) :])
    return out


TEMPLATES = _templates()


def _words(buf, offs):
    """Word hashes, their byte spans, and the rows' offsets into them."""
    low = A.LOWER[buf]
    starts, ends, rows = A.word_spans(low, offs, A.ALNUM)
    return A.word_hash(low, starts, ends), starts, ends, rows


def winnow(hashes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the fingerprints: the smallest of each window, rightmost of equals."""
    if not len(hashes):
        return np.empty(0, np.int64)
    window = min(window, len(hashes))
    out = set()
    for a in range(len(hashes) - window + 1):
        part = hashes[a : a + window]
        out.add(a + window - 1 - int(np.argmin(part[::-1])))
    return np.array(sorted(out), np.int64)


def _rarest(raw: bytes, starts: np.ndarray, ends: np.ndarray, coverage: float) -> list[int]:
    """Places of one word more than a match may lack: long ones, not COMMON."""
    words = [raw[a:b].decode().lower() for a, b in zip(starts.tolist(), ends.tolist())]
    n = len(words) - math.ceil(coverage * len(words) - 1e-9) + 1
    return sorted(range(len(words)), key=lambda p: (words[p] in COMMON, -len(words[p]), p))[:n]


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    look: dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]]  # by shingle size: keys, bounds, template, place


def build(templates: dict[str, list[str]], coverage: float = COVERAGE) -> Index:
    """The inverted index. A template below SHORT words is too short for winnowed
    shingles to meet every match; of its words, one more is indexed than a match
    may lack, so each match holds one of them."""
    names, words, found = [], [], {}
    for name, texts in templates.items():
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            w, starts, ends, _ = _words(raw, np.array([0, len(raw)]))
            if not len(w):
                continue
            k = 1 if len(w) < SHORT else SHINGLE
            h = A.window_hash(A.prefix_sums(w, 2), k, 2)
            for p in winnow(h).tolist() if k > 1 else _rarest(text.encode(), starts, ends, coverage):
                found.setdefault(k, []).append((int(h[p]), len(names), p))
            names.append(name)
            words.append(w)
    if sum(map(len, words)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"more than {MAX_TEMPLATE_WORDS} template words; split the templates and scan once for each part")
    look = {}
    for k, rows in found.items():
        rows.sort()
        keys = np.array([r[0] for r in rows], np.uint64)
        table = Lookup(keys)
        look[k] = (table, np.append(np.searchsorted(keys, table.keys), len(keys)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Index(names, words, look)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, start, end) of the template in the text, within `band` of
    template place + diagonal. The whole template is aligned; text before and
    after is free. Edits cost 1 each, matches gain 1; of equal scores the
    alignment that ends earlier."""
    m, width = len(template), 2 * band + 1
    low = -10 * m - 10
    score = np.zeros(width, np.int64)  # row 0: an empty template prefix, anywhere
    hit = np.zeros(width, np.int64)
    begin = diagonal - band + np.arange(width)
    inside = (begin >= 0) & (begin <= len(text))
    score[~inside] = low
    begin = begin.copy()
    for i in range(1, m + 1):
        j = i + diagonal - band + np.arange(width)  # text prefix length of each cell
        ok = (j >= 1) & (j <= len(text))
        equal = np.zeros(width, bool)
        equal[ok] = text[j[ok] - 1] == template[i - 1]
        diag = np.where(ok, score + np.where(equal, 1, -1), low)
        up = np.append(score[1:], low) - 1  # template word missing in the text
        take_up = up > diag
        new = np.where(take_up, up, diag)
        new_hit = np.where(take_up, np.append(hit[1:], 0), hit + equal)
        new_begin = np.where(take_up, np.append(begin[1:], 0), begin)
        for c in range(1, width):  # an extra word in the text
            if new[c - 1] - 1 > new[c] and j[c] <= len(text):
                new[c], new_hit[c], new_begin[c] = new[c - 1] - 1, new_hit[c - 1], new_begin[c - 1]
        score, hit, begin = new, new_hit, new_begin
    best = int(np.argmax(score))
    return int(hit[best]), max(0, int(begin[best])), m + diagonal - band + best


def matches(index: Index, words: np.ndarray, sums: np.ndarray, coverage: float = COVERAGE):
    """(template number, matched words, first word, end word) of one document."""
    diagonals = set()
    for k, (table, bounds, template, place) in index.look.items():
        at, key = table.find(A.window_hash(sums, k, 2))
        for p, i in zip(at.tolist(), key.tolist()):
            for r in range(bounds[i], bounds[i + 1]):
                diagonals.add((int(template[r]), p - int(place[r])))
    found, done = [], {}
    for t, d in sorted(diagonals):
        # Fingerprints of one occurrence name diagonals a few words apart.
        if t in done and d - done[t] <= BAND // 2:
            continue
        done[t] = d
        if not _possible(index.words[t], words, d, coverage):
            continue
        n, a, b = align(index.words[t], words, d)
        if n >= coverage * len(index.words[t]):
            found.append((t, n, a, b))
    found.sort(key=lambda x: (-x[1], len(index.words[x[0]]), x[0], x[2]))
    out = []
    for t, n, a, b in found:
        if not any(a < d and c < b if t == u else c <= a and b <= d for u, _, c, d in out):
            out.append((t, n, a, b))
    return sorted(out, key=lambda x: (x[0], -x[1], x[2]))


def _possible(template: np.ndarray, text: np.ndarray, diagonal: int, coverage: float) -> bool:
    """Whether enough of the template's words stand within BAND of their places:
    a bound that no alignment exceeds and that costs far less."""
    m, least = len(template), coverage * len(template)
    if len(text) < least:
        return False
    hit = np.zeros(m, bool)
    for d in range(diagonal - BAND, diagonal + BAND + 1):
        a, b = max(0, -d), min(m, len(text) - d)
        if a < b:
            hit[a:b] |= template[a:b] == text[a + d : b + d]
    return hit.sum() >= least


def _scan(index, coverage):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("doc_id", "license", "template_words", "matched_words", "coverage", "first_word", "end_word", "start_byte", "end_byte")}
            ids = batch.column("doc_id").to_pylist()
            for first, _, buf, offs in A.pieces(batch):
                words, starts, ends, rows = _words(buf, offs)
                sums = A.prefix_sums(words, 2)
                maybe = set()
                for k, (table, *_) in index.value.look.items():
                    at = table.find(A.window_hash(sums, k, 2))[0]
                    maybe |= set((np.searchsorted(rows, at, side="right") - 1).tolist())
                for d in sorted(maybe):
                    a, b = rows[d], rows[d + 1]
                    own = words[a:b]
                    for t, n, s, e in matches(index.value, own, A.prefix_sums(own, 2), coverage):
                        size = len(index.value.words[t])
                        row = (ids[first + d], index.value.names[t], size, n, n / size, s, e, starts[a + s] - offs[d], ends[a + e - 1] - offs[d])
                        for c, v in zip(out.values(), row):
                            c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each found occurrence of a template: doc_id, license, its words,
    how many of them matched, coverage, and the span in words and in bytes."""
    index = docs.sparkSession.sparkContext.broadcast(build(TEMPLATES if templates is None else templates, coverage))
    schema = "doc_id long, license string, template_words long, matched_words long, coverage double, first_word long, end_word long, start_byte long, end_byte long"
    return docs.select("doc_id", "text").mapInArrow(_scan(index, coverage), schema)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_licenses": op3_licenses}
