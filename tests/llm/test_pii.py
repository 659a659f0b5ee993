"""Personal data: spans against plain patterns, and the disclosure measure."""

import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sigloom.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def slow_spans(text):
    out = []
    for k, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 14 <= len(d) <= 19 and slow_luhn(d),
                "phone": lambda: 10 <= len(d) <= 15,
            }[name]()
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@-+ 0149()é\n", max_size=60))
def test_spans_equal_plain_patterns(text):
    assert P.base_spans(text) == slow_spans(text)


def test_known_spans():
    text = "é a.b@c.de@f.gh, 10.0.0.256 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 or +1 (724) 555-7058"
    assert P.base_spans(text) == slow_spans(text)
    assert {k for _, k, _ in P.base_spans(text)} == {0, 1, 2, 3}


def test_long_runs_are_linear():
    assert P.base_spans("7" * 300_000) == []
    assert P.base_spans("a" * 300_000 + " @") == []


def test_query_rows(spark, sf):
    rows = {r.doc_id: r for r in P.op8_pii(spark, sf).collect()}
    for d, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        base = slow_spans(text)
        line = ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in base)
        r = rows.pop(d)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert not line or set(line.split(",")) <= set(r.spans.split(","))
    assert not rows


SCHEMA = "doc_id long, text string, entity string, marks string, n_chars long"


def corpus():
    r = random.Random(1)
    texts = [f"note {i} from zorbax chief bob@corp.example.org about the plan" for i in range(4)]
    texts += [f"the plan of {r.randint(0, 9)} for chief people and the rest number {i}" for i in range(60)]
    return texts + [None, "", "the " * 3000, "bob@corp.example.org zorbax", "zorbax"]


def test_disclosing_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", "y", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    docs = [t or "" for t in texts]
    pairs, ents = {}, {}
    for t in docs:
        spans = P.base_spans(t)
        for e in {P.entity(t, s) for s in spans}:
            ents[e] = ents.get(e, 0) + 1
        for p in {(e, w) for e, w, _, _ in P.contexts(t, spans)}:
            pairs[p] = pairs.get(p, 0) + 1
    freq = lambda w: sum(w in {P._term(x) for x in t.split()} for t in docs)
    want = {(e, w) for (e, w), n in pairs.items() if n >= 3 and math.log(n * len(docs) / (freq(w) * ents[e])) >= 0.9 * math.log(len(docs) / ents[e])}
    assert {(r.entity, r.term) for r in P.disclosing(df).collect()} == want
    assert ("email:bob@corp.example.org", "zorbax") in want
    assert ("email:bob@corp.example.org", "the") not in want
    out = {r.doc_id: r for r in P.sanitise(df).collect()}
    assert P.sanitise(df).columns == df.columns
    assert out[0].text == "note 0 from <TERM> chief <EMAIL> about the plan".replace("note", out[0].text.split()[0]).replace("from", out[0].text.split()[2]).replace("about", out[0].text.split()[6])
    assert out[0].n_chars == len(out[0].text)
    assert out[len(texts) - 1].text == "zorbax"  # no entity beside it
    assert out[64].text is None and out[65].text == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.sanitise(df).count() == 0 and P.annotate(df).count() == 0


def test_terms_far_from_their_entity(spark):
    """Whole documents are counted, and every occurrence of a term is marked."""
    far = " ".join(f"w{k}" for k in range(40))
    texts = [f"zorbax {far} mail bob@corp.example.org {far} zorbax, and {i}" for i in range(4)]
    texts += [f"{far} mail and number {i}" for i in range(60)] + ["see Zorbax, there"]
    df = spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {tuple(r) for r in P.disclosing(df).collect()} == {("email:bob@corp.example.org", "zorbax")}
    near = {r.doc_id: r.text for r in P.sanitise(df).collect()}
    assert near[0] == f"<TERM> {far} mail <EMAIL> {far} <TERM> and 0" and near[64] == texts[64]
    out = {r.doc_id: r.text for r in P.sanitise(df, everywhere=True).collect()}
    assert out[0] == near[0] and out[64] == "see <TERM> there" and out[10] == texts[10]
    spans = {r.doc_id: r.spans for r in P.annotate(df, everywhere=True).collect()}
    assert spans[64] == "term:4:11" and spans[10] == ""


def slow_terms(text):
    """(term, start, end) of words apart from entities, by other means than the operator's."""
    taken = [(a, b) for a, _, b in slow_spans(text)]
    out = []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        a, b = m.span()
        if not any(x < b and a < y for x, y in taken) and (t := re.sub(r"""^[.,;:!?()\[\]{}"'|]+|[.,;:!?()\[\]{}"'|]+$""", "", m.group()).lower()):
            out.append((t, a, b))
    return out


def slow_all_spans(texts, alpha=0.9, min_docs=3):
    """Of each text: entities, and every occurrence of a disclosing term."""
    ents, pairs, df = {}, {}, {}
    for t in texts:
        own = {(k, t[a:b].lower()) for a, k, b in slow_spans(t)}
        here = {w for w, _, _ in slow_terms(t)}
        for w in {re.sub(r"""^[.,;:!?()\[\]{}"'|]+|[.,;:!?()\[\]{}"'|]+$""", "", x).lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t)}:
            df[w] = df.get(w, 0) + 1
        for e in own:
            ents[e] = ents.get(e, 0) + 1
            for w in here:
                pairs[(e, w)] = pairs.get((e, w), 0) + 1
    n = len(texts)
    found = {w for (e, w), k in pairs.items() if k >= min_docs and ents[e] < n and math.log(k * n / (df[w] * ents[e])) >= alpha * math.log(n / ents[e]) - 1e-12}
    return [sorted([*slow_spans(t), *((a, 4, b) for w, a, b in slow_terms(t) if w in found)]) for t in texts]


def test_query_spans_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    names = (*PLAIN, "term")
    want = {d: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans) for (d, _), spans in zip(rows, slow_all_spans([t for _, t in rows]))}
    assert {r.doc_id: r.spans for r in P.op8_pii(spark, sf).collect()} == want
    texts = [t or "" for t in corpus()] + [t for _, t in rows][:50]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in enumerate(texts)], SCHEMA)
    lines = [",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans) for spans in slow_all_spans(texts)]
    assert {r.doc_id: r.spans for r in P.annotate(df, everywhere=True).collect()} == dict(enumerate(lines))
    assert any("term" in v for v in lines)


def test_crowded_screens_change_nothing(spark, monkeypatch):
    """Screens of so few slots that all keys share them still lose and add nothing."""
    texts = [f"{a} with {b} of {w}@corp.example.org" for w, a, b in (("bob", "zorbax", "quill"), ("eve", "vantor", "marl")) for _ in range(4)]
    texts += [f"people with number {i} of it" for i in range(40)] + ["quill"]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in enumerate(texts)], SCHEMA)
    want = {tuple(r) for r in P.disclosing(df).collect()}
    spans = [sorted(map(tuple, P.annotate(df, everywhere=e).collect())) for e in (True, False)]
    monkeypatch.setattr(P, "SCREEN_BITS", 0)
    monkeypatch.setattr(P, "REMEMBERED", 2)
    assert {tuple(r) for r in P.disclosing(df).collect()} == want and len(want) == 4
    assert [sorted(map(tuple, P.annotate(df, everywhere=e).collect())) for e in (True, False)] == spans


def test_many_entities_in_one_text(spark):
    text = " ".join(f"word{i % 50} user{i}@corp.example.org" for i in range(20_000))
    df = spark.createDataFrame([(i, text if i < 2 else "word1 and more", "x", "y", 0) for i in range(6)], SCHEMA)
    assert {r.doc_id: r.n_email for r in P.annotate(df, everywhere=True).collect()} == {0: 20_000, 1: 20_000} | {i: 0 for i in range(2, 6)}


def test_terms_with_other_blanks(spark):
    """Only ASCII blanks part words, in the frequencies too."""
    texts = [f"nom\u00a0zorbax: bob@corp.example.org {i}" for i in range(4)] + [f"people and number {i}" for i in range(40)]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {tuple(r) for r in P.disclosing(df).collect()} == {("email:bob@corp.example.org", "nom\u00a0zorbax")}
