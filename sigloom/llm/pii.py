"""Personal data: patterns, then information-theoretic sanitisation.

Patterns (fixed by the query's contract) find e-mail addresses, IPs, cards and
phone numbers; these are the protected entities. The sanitiser asks which other
terms give them away. For a term t and an entity e it compares

    PMI(t; e) = log( p(t, e) / (p(t) p(e)) )   with   IC(e) = -log p(e),

all probabilities being shares of the corpus' documents. PMI reaches IC when
every document with t also holds e; t discloses e when PMI >= ALPHA * IC and the
pair stands together in at least MIN_DOCS documents (once is no evidence).
Terms that disclose are generalised to a placeholder: with `everywhere` (the
query and the pipeline) wherever they stand, otherwise wherever they stand in a
document that holds an entity that they disclose.

Statistics cover whole documents, and all of them. Pairs are counted only where
they can reach the threshold. With de and df the numbers of documents of e and
t, and N of all, it asks for n(t, e) >= df * (de / N)^(1 - ALPHA). As n is at
most de, rarer entities than MIN_DOCS go first; then terms that stand in fewer
than MIN_DOCS documents with an entity left; then pairs with df above
de * (N / de)^(1 - ALPHA). These bounds lose no pair. Counts are summed before the
shuffle, so a hot entity has one row for each term and batch, dealt out by the
pair. Which entities and terms still matter goes to the scans as a screen: hash
slots with the bound of whatever fell into each. A screen has a bounded size and
loses nothing; what it lets through for nothing goes in the exact joins after it.
So each statistic takes one scan, however many entities and terms there are.

Defined results: null text is empty; null ids stay; repeated rows are counted and
marked one by one; an empty table gives no rows; other columns pass unchanged
through `sanitise` (n_chars, if it is there, is set to the new length).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import arrays as A
from sigloom.llm.names import fresh
from sigloom.llm.store import Kept

ALPHA = 0.9
MIN_DOCS = 3
SCREEN_BITS = 22  # slots of a screen, at most
REMEMBERED = 400_000  # bounds that a task keeps by name
#: Counts that a worker holds before it hands them on.
FLUSH = 300_000
#: The patterns of the contract, in the order of kinds.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Without the look-behind and the possessive runs (which change no match) a long
#: run of digits would take quadratic time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile("[0-9]")
#: The run of address characters that ends at an @ sign, read backwards.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the contract's matches, in order."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in _parts(m.group())):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _parts(ip: str) -> list[str]:
    """The numbers of a dotted match; very long ones are cut, they fail anyway."""
    return [(p.lstrip("0") or "0")[:4] for p in ip.split(".")]


def _emails(text: str):
    """The pattern's leftmost matches. A search from each place on is quadratic
    in long runs without an @, so it starts at the run before the next @."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", max(done, at + 1))


def entity(text: str, span: tuple[int, int, int]) -> str:
    """An entity's name in the statistics: its kind and its characters."""
    return f"{KINDS[span[1]]}:{text[span[0] : span[2]].lower()}"


def words(text: str, spans: list[tuple[int, int, int]]):
    """(term, start, end) of the words that no entity overlaps."""
    taken, k, reach = sorted((s, e) for s, _, e in spans), 0, 0
    for m in WORD.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][0] < end:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= start and (term := _term(m.group())):
            yield term, start, end


def contexts(text: str, spans: list[tuple[int, int, int]]):
    """(entity, term, start, end) of a document's words, for each of its entities."""
    own = list(words(text, spans)) if spans else []
    for name in sorted({entity(text, s) for s in spans}):
        for term, start, end in own:
            yield name, term, start, end


def _term(word: str) -> str:
    return word.strip(".,;:!?()[]{}\"'|").lower()


def _texts(batch: pa.RecordBatch):
    for t in batch.column("text"):
        yield t.as_py() or ""


def _counted(of, *names: str):
    """Rows (*names, n): how many texts give each key, summed by batch or FLUSH."""
    schema = pa.schema([*((c, pa.string()) for c in names), ("n", pa.int64())])

    def rows(n: Counter) -> pa.RecordBatch:
        keys = zip(*n) if len(names) > 1 and n else [list(n)] * len(names)
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(list(n.values()), pa.int64())], schema=schema)

    @A.giving_back
    def run(batches):
        count = of()
        for batch in batches:
            n: Counter = Counter()
            for text in _texts(batch):
                n.update(count(text))
                if len(n) > FLUSH:
                    yield rows(n)
                    n = Counter()
            yield rows(n)

    return run


def _sums(docs: DataFrame, of, *names: str) -> DataFrame:
    """How many texts give each key. `of` makes, in each task, the function that
    gives a text's keys."""
    schema = ", ".join([*(f"{c} string" for c in names), "n long"])
    return docs.mapInArrow(_counted(of, *names), schema).groupBy(*names).agg(F.sum("n").alias("n"))


class Screen:
    """A bound for each key of a table, from hash slots: 0 for keys that are not in
    it, as a rule; otherwise the largest (or smallest) value of the key's slot."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def of(cls, df: DataFrame, key: str, value: Column, smallest: bool = False) -> Screen:
        bits = min(SCREEN_BITS, max(10, df.count().bit_length() + 4))
        slot = F.expr(f"xxhash64({key}) & {(1 << bits) - 1}")
        best = df.groupBy(slot.alias("slot")).agg((F.min if smallest else F.max)(value.cast("double")).alias("v")).toArrow()
        slots = np.zeros(1 << bits)
        slots[best.column("slot").to_numpy()] = best.column("v").to_numpy()
        return cls(slots)

    def reader(self):
        """key -> bound; remembers the commonest keys' bounds."""
        mask, slots, known = len(self.slots) - 1, self.slots, {}

        def bound(key: str) -> float:
            v = known.get(key)
            if v is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                # Spark's xxhash64 of a string has this seed.
                v = known[key] = float(slots[xxhash.xxh64_intdigest(key.encode(), 42) & mask])
            return v

        return bound


def _entities():
    """A text's entities, and null, which counts the texts."""
    return lambda text: {None, *(entity(text, s) for s in base_spans(text))}


def _terms_beside(ents):
    """The terms of texts that hold an entity that the screen knows."""

    def make():
        known = ents.value.reader()

        def of(text):
            spans = base_spans(text)
            return {t for t, _, _ in words(text, spans)} if any(known(entity(text, s)) for s in spans) else ()

        return of

    return make


def _known_terms(terms):
    """A text's terms that the screen knows, entities' words among them."""

    def make():
        known, seen = terms.value.reader(), {}

        def of(text):
            out = set()
            # Bytes are parted at the six ASCII blanks, as WORD does.
            for w in set(text.encode().split()):
                t = seen.get(w)
                if t is None:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    t = _term(w.decode())
                    t = seen[w] = t if t and known(t) else ""
                if t:
                    out.add(t)
            return out

        return of

    return make


def _pairs(ents, terms):
    """(entity, term) of each text where the term's df may be within the entity's bound."""

    def make():
        most, least = ents.value.reader(), terms.value.reader()

        def of(text):
            spans = base_spans(text)
            own = [(e, most(e)) for e in {entity(text, s) for s in spans}]
            own = [(e, m) for e, m in own if m]
            if not own:
                return
            here = [(t, least(t)) for t in {t for t, _, _ in words(text, spans)}]
            here = [(t, n) for t, n in here if n]
            for e, m in own:
                yield from ((e, t) for t, n in here if n <= m)

        return of

    return make


def disclosing(docs: DataFrame, alpha: float = ALPHA, min_docs: int = MIN_DOCS) -> DataFrame:
    """(entity, term): the terms that reveal an entity more than the threshold."""
    docs = docs.select("text")
    sc = docs.sparkSession.sparkContext
    none = docs.sparkSession.createDataFrame([], "entity string, term string")
    often = Kept(_sums(docs, _entities, "entity").filter(F.col("entity").isNull() | (F.col("n") >= min_docs)), "entities").df
    total = float(often.filter("entity IS NULL").agg(F.sum("n")).first()[0] or 0)
    # An entity of every document has no information to disclose.
    often = often.filter(F.col("entity").isNotNull() & (F.col("n") < total)).withColumnRenamed("n", "de")
    # A little above the bound, for the rounding of powers.
    most = F.col("de") * F.pow(F.lit(total) / F.col("de"), F.lit(1 - alpha)) * (1 + 1e-9)
    largest = often.agg(F.max(most)).first()[0]
    if largest is None:
        return none
    ents = sc.broadcast(Screen.of(often, "entity", most))
    beside = Kept(_sums(docs, _terms_beside(ents), "term").filter(F.col("n") >= min_docs).select("term"), "terms")
    known = sc.broadcast(Screen.of(beside.df, "term", F.lit(1)))
    df = _sums(docs, _known_terms(known), "term").filter(F.col("n") <= largest).withColumnRenamed("n", "df")
    df = Kept(df.join(beside.df, "term", "left_semi"), "frequencies").df
    beside.drop()
    rare = sc.broadcast(Screen.of(df, "term", F.col("df"), smallest=True))
    pairs = _sums(docs, _pairs(ents, rare), "entity", "term").filter(F.col("n") >= min_docs)
    pmi = F.log(F.col("n") * F.lit(total) / (F.col("df") * F.col("de")))
    ic = -F.log(F.col("de") / F.lit(total))
    return pairs.join(often, "entity").join(df, "term").filter(pmi >= F.lit(alpha) * ic).select("entity", "term")


def _marks_of_texts(found, everywhere: bool):
    """(key, entity, term) of the terms that may be marked in each text, with its
    entities (null with `everywhere`); the key is the text's."""

    @A.giving_back
    def run(batches):
        known = _known_terms(found)()
        for batch in batches:
            out = {"key": [], "entity": [], "term": []}
            for key, text in zip(batch.column("key").to_pylist(), _texts(batch)):
                here = known(text)
                spans = base_spans(text) if here else []
                own = [None] if everywhere else {entity(text, s) for s in spans}
                for t in {t for t, _, _ in words(text, spans)} & here if here and own else ():
                    for e in own:
                        out["key"].append(key)
                        out["entity"].append(e)
                        out["term"].append(t)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("entity", pa.string()), ("term", pa.string())]))

    return run


BROADCAST_MARKS = 100_000


def _marked(docs: DataFrame, everywhere: bool) -> tuple[DataFrame, str]:
    """The documents with a column of the terms to mark in each text, and its
    name. They depend on the text alone, so they are joined by its hash: null and
    repeated ids don't matter. Few marks are broadcast; more are joined by a
    shuffle."""
    key, name, own = F.xxhash64("text"), fresh(docs, "marks"), fresh(docs, "text_key")
    found = Kept(disclosing(docs), "disclosing").df
    if found.isEmpty():
        return docs.withColumn(name, F.lit(None).cast("array<string>")), name
    screen = docs.sparkSession.sparkContext.broadcast(Screen.of(found.select("term").distinct(), "term", F.lit(1)))
    near = docs.select(key.alias("key"), "text").mapInArrow(_marks_of_texts(screen, everywhere), "key long, entity string, term string")
    on = ["term"] if everywhere else ["entity", "term"]
    kept = Kept(near.join(found.select(*on).distinct(), on, "left_semi").groupBy("key").agg(F.collect_set("term").alias(name)), "marks").df
    marks = kept.withColumnRenamed("key", own)
    if kept.count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    return docs.withColumn(own, key).join(marks, own, "left").drop(own), name


def all_spans(text: str, found: set) -> list[tuple[int, int, int]]:
    """Base spans, and those of the found terms (kind number 4)."""
    spans = base_spans(text)
    if found:
        spans = sorted([*spans, *((s, 4, e) for t, s, e in words(text, spans) if t in found)])
    return spans


_NAMES = (*KINDS, "term")


def _line(spans) -> str:
    return ",".join(f"{_NAMES[k]}:{s}:{e}" for s, k, e in spans)


@A.giving_back
def _report(batches):
    for batch in batches:
        out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for text, marks in zip(_texts(batch), batch.column("marks")):
            spans = all_spans(text, set(marks.as_py() or ()))
            base = [s for s in spans if s[1] < 4]
            n = Counter(k for _, k, _ in base)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(n[k])
            out["base_sha256"].append(hashlib.sha256(_line(base).encode()).hexdigest())
            out["spans"].append(_line(spans))
        cols = [pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], ["doc_id", *out])


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced: entities by their
    kind, terms by a general placeholder."""
    out, pos, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            kind, end = min(kind, spans[k][1]), max(end, spans[k][2])
            k += 1
        out += [text[pos:start], f"<{_NAMES[kind].upper()}>"]
        pos = end
    return "".join([*out, text[pos:]])


def _rewrite(names: list[str], own: str):
    @A.giving_back
    def run(batches):
        for batch in batches:
            texts = []
            for v, marks in zip(batch.column("text"), batch.column(own)):
                text = v.as_py()
                spans = all_spans(text, set(marks.as_py() or ())) if text else []
                texts.append(replaced(text, spans) if spans else text)
            batch = batch.select(names)
            k = batch.schema.get_field_index("text")
            batch = batch.set_column(k, "text", pa.array(texts, batch.schema.field(k).type))
            if "n_chars" in names:
                k = batch.schema.get_field_index("n_chars")
                old = batch.column("n_chars").to_pylist()
                n = [o if t is None or o is None else len(t) for t, o in zip(texts, old)]
                batch = batch.set_column(k, "n_chars", pa.array(n, batch.schema.field(k).type))
            yield batch

    return run


def annotate(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """doc_id, counts by kind, the base spans' hash, and all spans of each row."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return _marked(docs.select("doc_id", "text"), everywhere)[0].mapInArrow(_report, schema)


def sanitise(docs: DataFrame, everywhere: bool = False) -> DataFrame:
    """All rows, with entities and disclosing terms replaced in their texts."""
    marked, name = _marked(docs, everywhere)
    return marked.mapInArrow(_rewrite(docs.columns, name), docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"), everywhere=True)


QUERIES = {"op8_pii": op8_pii}
