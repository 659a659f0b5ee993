"""Rule-based quality filter: a threshold table compiled into one projection.

The table is compiled into the oracle's SQL as well, from measures written there
by other means. No rule rejects a text for being long.

Base measures (fixed by the query's contract) and ratio rules are all built-in
column expressions; no Python runs on the executors and nothing is shuffled.

Defined results: a null or empty text has no words and fails the base rule; a
null doc_id stays null; other columns are not read; an empty table gives an
empty result. Repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.names import sealed

BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"
NOT_BLANK = "[^ \\t\\n\\x0B\\f\\r]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Common function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for was with be by this at are from as on a".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
}


@dataclass(frozen=True)
class Rule:
    """Keep a document if low <= measure <= high; a null measure passes."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0  # shorter documents are not judged by this rule


#: The production table. A rule needs enough words for its ratio to mean anything.
RULES = (
    Rule("mean_word_chars", low=2.0, high=14.0, min_words=20),
    Rule("symbol_ratio", high=0.10),
    Rule("symbol_word_ratio", high=0.25),
    Rule("echo_ratio", high=0.30),
    Rule("stop_word_ratio", low=0.01, min_words=60),
    Rule("dup_line_ratio", high=0.60),
    Rule("upper_ratio", high=0.60),
    Rule("exclaim_ratio", high=0.30),
    Rule("pipe_line_ratio", high=0.80),
)


def _chars_of(text: Column, not_them: str) -> Column:
    """How many characters are left when the pattern's matches go."""
    return F.length(F.regexp_replace(text, not_them, ""))


def _measures(df: DataFrame, text: str) -> DataFrame:
    """Adds the columns that the rules and the contract read, under `_q`."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_t", t).withColumn("_w", F.filter(F.split("_t", BLANK_RUN), lambda w: w != ""))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda s: F.rlike(s, F.lit(NOT_BLANK))))
    # Hashes of 1, 2, 4 and 8 words from each start, each from two of the former
    # (WINDOW is 8); the last few, which run over the end, are cut off.
    df = df.withColumn("_x", F.transform("_w", lambda w: F.xxhash64(w)))
    wide = "_x"
    for k in (1, 2, 4):
        df = df.withColumn(f"_x{k}", F.expr(f"zip_with({wide}, slice({wide}, {k + 1}, size({wide})), (a, b) -> xxhash64(a, b))"))
        wide = f"_x{k}"
    df = df.withColumn("_h", F.expr(f"slice({wide}, 1, greatest(size({wide}) - {WINDOW - 1}, 0))"))
    # Most texts repeat no window. The others pay for a sort of (hash, start)
    # pairs; each repeated start then adds the words up to the next one.
    df = df.withColumn("_again", F.expr("size(_h) <> size(array_distinct(_h))"))
    pairs = "array_sort(zip_with(_h, sequence(0, size(_h) - 1), (h, i) -> struct(h, i)))"
    df = df.withColumn("_p", F.expr(f"CASE WHEN _again THEN {pairs} END"))
    df = df.withColumn(
        "_d",
        F.expr(
            """CASE WHEN _again THEN sort_array(transform(filter(_p, (x, k) ->
              (k > 0 AND element_at(_p, greatest(k, 1)).h = x.h) OR
              (k + 1 < size(_p) AND element_at(_p, least(k + 2, size(_p))).h = x.h)), x -> x.i)) END"""
        ),
    )
    return df.withColumn(
        "n_repeat_words",
        F.expr(
            f"""CASE WHEN _again THEN aggregate(
              zip_with(_d, concat(slice(_d, 2, size(_d) - 1), array(2147483647)), (a, b) -> least(b - a, {WINDOW})),
              0L, (acc, g) -> acc + g) ELSE 0L END"""
        ),
    )


def annotate(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, base measures, base_failed, kept; one row per input row."""
    return _judged(docs.select(F.col("doc_id").alias("in0"), F.col("text").alias("_src")), rules).withColumnRenamed("in0", "doc_id")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, columns unchanged."""
    inner, restored = sealed(docs)
    text = f"in{[c.lower() for c in docs.columns].index('text')}"
    # The filter reads a row number, which keeps the optimizer from pushing it
    # below the projection and computing every measure twice, unshared.
    judged = _judged(inner.withColumn("_src", F.col(text)), rules).withColumn("_row", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_row") >= 0)).select(*restored)


def _judged(src: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The `in` columns, base measures and verdict of rows with their text in _src."""
    passed = [c for c in src.columns if c != "_src"]
    df = _measures(src, "_src")
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    df = df.select(
        *passed,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _chars_of(F.col("_t"), f"[^{SYMBOLS}]+").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_lines"),
        _chars_of(F.col("_t"), "[^\\p{Lu}]+").alias("_upper"),
        (F.size(F.split("_t", "!")) - 1).alias("_exclaim"),
        F.size(F.filter("_l", lambda s: F.contains(s, F.lit(" | ")))).alias("_piped"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(stop))).alias("_stop"),
        F.expr("size(filter(_x, (h, k) -> k > 0 AND h = get(_x, k - 1)))").alias("_echo"),
    )
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    n = F.col("n_words").cast("double")
    measure = {
        "n_words": n,
        "mean_word_chars": F.try_divide(F.col("word_chars").cast("double"), n),
        "symbol_ratio": F.try_divide(F.col("n_symbols").cast("double"), F.col("word_chars").cast("double")),
        "symbol_word_ratio": F.try_divide(F.col("n_symbols").cast("double"), n),
        "echo_ratio": F.try_divide(F.col("_echo").cast("double"), n),
        "stop_word_ratio": F.try_divide(F.col("_stop").cast("double"), n),
        "dup_line_ratio": F.try_divide(F.col("n_dup_lines").cast("double"), F.col("_lines").cast("double")),
        "upper_ratio": F.try_divide(F.col("_upper").cast("double"), F.col("word_chars").cast("double")),
        "exclaim_ratio": F.try_divide(F.col("_exclaim").cast("double"), n),
        "pipe_line_ratio": F.try_divide(F.col("_piped").cast("double"), F.col("_lines").cast("double")),
    }
    ok = F.lit(True)
    for r in rules:
        m, good = measure[r.measure], F.lit(True)
        if r.low is not None:
            good = good & (m >= r.low)
        if r.high is not None:
            good = good & (m <= r.high)
        ok = ok & F.coalesce(F.when(n >= r.min_words, good), F.lit(True))
    return df.select(
        *passed, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & ok).alias("kept"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The rules' measures in the oracle's columns.
_MEASURES_SQL = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / n_words",
    "symbol_ratio": "n_symbols / word_chars",
    "symbol_word_ratio": "n_symbols / n_words",
    "echo_ratio": "echo / n_words",
    "stop_word_ratio": "stop / n_words",
    "dup_line_ratio": "n_dup_lines / lines",
    "upper_ratio": "upper_chars / word_chars",
    "exclaim_ratio": "exclaim / n_words",
    "pipe_line_ratio": "piped / lines",
}


def _rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The table as a condition on base rows (which have 20 words at least)."""
    out = []
    for r in rules:
        m = _MEASURES_SQL[r.measure]
        bounds = [f"{m} {op} {v!r}" for op, v in ((">=", r.low), ("<=", r.high)) if v is not None]
        out.append(f"(n_words < {r.min_words} OR ({' AND '.join(bounds)}))")
    return " AND ".join(out)


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM t),
h AS (SELECT *, CASE WHEN len(w) >= {WINDOW} THEN
    list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(list_slice(w, i, i + {WINDOW} - 1), ' '))
    ELSE [] END AS h FROM w),
e AS (SELECT doc_id, unnest(h) AS g, generate_subscripts(h, 1) AS i FROM h),
d AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM
    (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM e) WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(least(coalesce(j - i, {WINDOW}), {WINDOW})) AS BIGINT) AS n FROM d GROUP BY doc_id),
m AS (SELECT h.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words,
    len(l) AS lines,
    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper_chars,
    len(string_split(t, '!')) - 1 AS exclaim,
    len(list_filter(l, lambda x: contains(x, ' | '))) AS piped,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS stop,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS echo
    FROM h LEFT JOIN r ON h.doc_id = r.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND {_rules_sql()} AS kept
FROM b
"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": ORACLE}
