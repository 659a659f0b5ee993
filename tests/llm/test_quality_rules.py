"""Quality rules: base measures by brute force, the verdict, and odd inputs."""

import re
from collections import Counter

from sigloom.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, n_words string, _t string, in0 string, kept int"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    rep = {j for i in range(len(words) - 7) if n[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(rep) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep), failed


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h a b c d e f g h", "é ü # $ < > |\n\nx\nx\n x", "to " * 50, "a b c d e f g h i " * 40,
    " ".join(f"w{i}" for i in range(30000)), " ".join(f"w{i}" for i in range(5000)) + " " + " ".join(f"w{i}" for i in range(5000)),
    "The plan of the town is in the hands of the people and it is for them to see that all goes well with it.",
    "\x1c\x1d x y   z", "A\x0bB\x0cC\rD",
]


def test_measures(spark):
    df = spark.createDataFrame([(i, t, "a", "b", "c", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "a", "b", "c", 1)], SCHEMA)
    rows = Q.annotate(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[4 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(text), text
        assert not (r.kept and r.base_failed)
    assert {r.doc_id for r in rows if r.kept} == {10}  # 8 has no stop words
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_no_python_and_no_shuffle(spark, sf):
    plan = Q.op6_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert Q.annotate(spark.createDataFrame([], SCHEMA)).count() == 0
