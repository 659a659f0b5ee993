"""Licence scan against a full (unbanded, unfiltered) alignment."""

import re
from pathlib import Path

import numpy as np

from sigloom.llm import arrays as A
from sigloom.llm import licenses as L

SCHEMA = "doc_id long, text string, license string, coverage string"


def best_overlap(template, words):
    """Longest common subsequence inside any window of the template's length plus
    the band: what an alignment can match at most."""
    best = 0
    for s in range(max(1, len(words) - len(template) + 1)):
        part = words[s : s + len(template) + L.BAND]
        row = [0] * (len(part) + 1)
        for t in template:
            new = [0]
            for j, w in enumerate(part):
                new.append(row[j] + 1 if w == t else max(row[j + 1], new[-1]))
            row = new
        best = max(best, row[-1])
    return best


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_query_finds_the_notices(spark, sf):
    got = {(r.doc_id, r.license) for r in L.op3_licenses(spark, sf).collect()}
    want = set()
    for d, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = " " + " ".join(tokens(text)) + " "
        for name, texts in L.TEMPLATES.items():
            if any(" " + " ".join(tokens(t)) + " " in words for t in texts):
                want.add((d, name))
    assert want and want <= got
    for d, name in got - want:  # near matches: the words must be there
        text = spark.read.parquet(f"{sf}/documents.parquet").filter(f"doc_id = {d}").first().text
        assert any(best_overlap(tokens(t), tokens(text)) >= 0.8 * len(tokens(t)) for t in L.TEMPLATES[name])


def test_edits_and_edges(spark):
    mit = L.TEMPLATES["MIT"][1]
    words = mit.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 17 != 9)
    added = " ".join(w + (" indeed" if i % 13 == 5 else "") for i, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    rows = [(1, f"Intro text.\n{mit}\nend", "a", "b"), (2, changed, "a", "b"), (3, f"é {added} x", "a", "b"), (4, half, "a", "b"), (5, None, None, None), (6, "", "a", "b"), (None, mit.upper(), "a", "b"), (8, (mit + " between these two ") * 2, "a", "b"), (9, "word " * 20000 + mit, "a", "b"), (9, "word " * 20000 + mit, "a", "b")]
    out = L.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    n = {}
    for r in out:
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
        assert r.coverage >= 0.8 and r.license == "MIT"
    assert n == {1: 1, 2: 1, 3: 1, None: 1, 8: 2, 9: 2}
    whole = next(r for r in out if r.doc_id == 1)
    raw = rows[0][1].encode()
    assert whole.coverage == 1.0 and raw[whole.start_byte : whole.end_byte].decode() == mit.rstrip(".")
    assert all(r.coverage == 1.0 for r in out if r.doc_id == 3)


def test_winnowing_guarantee():
    """Any run of WINNOW + SHINGLE - 1 shared words shares a fingerprint."""
    r = np.random.default_rng(0)
    for _ in range(50):
        h = r.integers(0, 1 << 60, 40).astype(np.uint64)
        places = set(L.winnow(h).tolist())
        assert all(places & set(range(a, a + L.WINNOW)) for a in range(len(h) - L.WINNOW + 1))


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert len(A.codes(1)) == 256


def test_whole_texts_and_parts(spark):
    """A whole licence is one row with a span to its end, under its own name."""
    rows, want = [], set()
    for k, name in enumerate(L.WHOLE):
        whole = (Path(L.__file__).parent / "license_texts" / f"{name}.txt").read_text()
        rows.append((k, f"before it\n{whole}", "a", "b"))
        want.add((k, name, 2 + len(tokens(whole))))
    for k, name in enumerate(L.DISCLAIMERS, 100):
        whole = (Path(L.__file__).parent / "license_texts" / f"{name}.txt").read_text()
        part = whole[whole.index(L.DISCLAIMERS[name]) :]
        rows.append((k, part, "a", "b"))
        want.add((k, name, len(tokens(part))))
    for k, name in enumerate(L.NOTICES, 200):
        rows.append((k, L.NOTICES[name][0], "a", "b"))
        want.add((k, name, len(tokens(L.NOTICES[name][0]))))
    got = L.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.license, r.end_word) for r in got} == want and len(got) == len(want)


def test_short_notices_with_an_edit():
    """One word added or changed anywhere leaves a short notice to be found."""
    index = L.build(L.TEMPLATES)
    for text in [t for texts in L.NOTICES.values() for t in texts if len(tokens(t)) < L.SHORT]:
        words = tokens(text)
        for k in range(len(words)):
            for edited in (words[:k] + ["zz"] + words[k:], words[:k] + ["zz"] + words[k + 1 :]):
                raw = np.frombuffer(" ".join(["aa", *edited]).encode(), np.uint8)
                w = L._words(raw, np.array([0, len(raw)]))[0]
                assert L.matches(index, w, A.prefix_sums(w, 2)), edited


def whole_alignment(template, words):
    """(score, fewest and most matched words, of the best alignments of the template in
    all of the text), without a band: matches gain 1, edits cost 1."""
    n = len(words)
    score, least, most = np.zeros(n + 1, int), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for t in template:
        new, lo, hi = np.empty(n + 1, int), np.empty(n + 1, int), np.empty(n + 1, int)
        new[0], lo[0], hi[0] = score[0] - 1, least[0], most[0]
        for j in range(1, n + 1):
            eq = words[j - 1] == t
            ways = [(score[j - 1] + (1 if eq else -1), least[j - 1] + eq, most[j - 1] + eq), (score[j] - 1, least[j], most[j]), (new[j - 1] - 1, lo[j - 1], hi[j - 1])]
            new[j] = max(w[0] for w in ways)
            lo[j], hi[j] = min(w[1] for w in ways if w[0] == new[j]), max(w[2] for w in ways if w[0] == new[j])
        score, least, most = new, lo, hi
    best = score.max()
    at = np.flatnonzero(score == best)
    return int(best), int(least[at].min()), int(most[at].max())


def test_query_rows_equal_whole_alignments(spark, sf):
    """Matched words and spans of the query's rows are those of a best alignment
    around them; coverage follows."""
    texts = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = L.op3_licenses(spark, sf).collect()
    assert rows
    for r in rows:
        around = texts[r.doc_id][max(0, r.first_word - 12) : r.end_word + 12]
        own = texts[r.doc_id][r.first_word : r.end_word]
        fits = []
        for t in L.TEMPLATES[r.license]:
            if len(tokens(t)) == r.template_words and len(own) < 400:
                best, _, _ = whole_alignment(tokens(t), around)
                score, least, most = whole_alignment(tokens(t), own)
                fits.append(score == best and least <= r.matched_words <= most)
        assert any(fits) or len(own) >= 400
        assert r.coverage == r.matched_words / r.template_words >= 0.8


def test_edited_notices_are_all_found(spark):
    """Random edits: whatever a whole alignment puts at the coverage is reported."""
    r = np.random.default_rng(5)
    notices = [(n, t) for n, ts in L.NOTICES.items() for t in ts if len(tokens(t)) <= 60]
    rows, want = [], {}
    for k in range(150):
        name, text = notices[k % len(notices)]
        words = tokens(text)
        for _ in range(r.integers(0, 1 + len(words) // 5)):
            at = r.integers(0, len(words) + 1)
            kind = r.integers(0, 3)
            words[at : at + int(kind > 0)] = [f"zz{r.integers(9)}"] * int(kind < 2)
        body = [f"q{x}" for x in r.integers(0, 50, 30)]
        doc = body + words + body[::-1]
        score, _, _ = whole_alignment(tokens(text), doc)
        if score >= 0.8 * len(tokens(text)):
            want[k] = name
        rows.append((k, " ".join(doc), "a", "b"))
    got = {}
    for x in L.scan(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert len(want) > 40
    for k, name in want.items():
        assert any(x.license == name or x.coverage >= 0.8 for x in got.get(k, [])), rows[k][1]
    assert sum(any(x.license == n for x in got[k]) for k, n in want.items()) >= 0.95 * len(want)
