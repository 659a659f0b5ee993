"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power a, normalised. The exponent a
in [0, 1] is bisected: the largest a whose weights still reach the target
entropy, raised if need be to the smallest a at which no source is repeated
more often than the limit. Weights become token budgets, and budgets become
passes over a source's blocks in hashed order: as many whole passes as fit, then
one over the first blocks of a permutation, cut inside the last block.

Everything is a column expression or a grouped sum. Tokens are counted in one scan
and written; a second scan gives the rows. A hot source is split into blocks of
about BLOCK_TOKENS before anything is ordered, and its blocks into groups whose
sums are ordered first, so no window holds a source's blocks or documents.
Documents are ordered in boundary blocks only. The driver sees 65 rows of each
bisection round.

Defined results: null text has no tokens; null is a source of its own; a source
without tokens gets no budget and no rows; a null doc_id is hashed as its text;
repeated rows are mixed one by one, and where a partial pass ends among rows of one
id and text as many of them are taken as fit; an empty table gives no rows; other
columns pass through `realise` unchanged, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.names import sealed
from sigloom.llm.store import Kept

ENTROPY_RATIO = 0.97  # of the entropy of equal weights
MAX_REPEATS = 4.0
BLOCK_TOKENS = 100_000
SEED = "mix-1"
ROUNDS, POINTS = 4, 64  # each round is log2(POINTS) bisection steps


def token_count(text: Column) -> Column:
    """Blank-separated words."""
    return F.size(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")


def _hash32(*parts: Column) -> Column:
    """A number below 2**32 from MD5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """(mix_key, tokens) of the sources that have tokens."""
    return docs.groupBy("mix_key").agg(F.sum("mix_tokens").alias("tokens")).filter("tokens > 0")


def _grid(sources: DataFrame, total: int, budget: int, lo: float, hi: float) -> list:
    """Entropy and largest repetition at POINTS + 1 exponents from lo to hi."""
    q, a = F.col("tokens") / F.lit(float(total)), F.col("a")
    points = F.array(*(F.lit(lo + (hi - lo) * j / POINTS) for j in range(POINTS + 1)))
    per = sources.select("tokens", F.explode(points).alias("a")).select("a", F.pow(q, a).alias("w"), (F.pow(q, a) * a * F.log(q)).alias("s"), F.pow(q, a - 1).alias("r"))
    sums = per.groupBy("a").agg(F.sum("w").alias("z"), F.sum("s").alias("s"), F.max("r").alias("r"))
    return sums.select("a", (F.log("z") - F.col("s") / F.col("z")).alias("entropy"), (F.col("r") / F.col("z") * F.lit(budget / total)).alias("repeats")).orderBy("a").collect()


def exponent(sources: DataFrame, total: int, budget: int, n_sources: int, entropy_ratio: float = ENTROPY_RATIO, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent, to 2**-24."""
    if max_repeats < budget / total:
        raise ValueError(f"a budget of {budget} tokens needs more than {max_repeats} passes over {total}")
    target = entropy_ratio * math.log(n_sources) - 1e-12

    def settle(good_low):
        """The boundary of a predicate that holds from 0 up (or from 1 down)."""
        lo, hi = 0.0, 1.0
        for k in range(ROUNDS):
            rows = _grid(sources, total, budget, lo, hi)
            if good_low:
                good = [r["entropy"] >= target for r in rows]
                if k == 0 and good[-1]:
                    return 1.0
                j = max(i for i in range(POINTS) if good[i] or i == 0)
            else:
                good = [r["repeats"] <= max_repeats for r in rows]
                if k == 0 and good[0]:
                    return 0.0
                j = min(i for i in range(1, POINTS + 1) if good[i] or i == POINTS) - 1
            lo, hi = rows[j]["a"], rows[j + 1]["a"]
        return lo if good_low else hi

    return max(settle(True), settle(False))


def realise(docs: DataFrame, budget: int | None = None, entropy_ratio: float = ENTROPY_RATIO, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture: each document once for each pass that takes it, with all its
    columns and mix_tokens, mix_pass (from 0), mix_block, mix_order. Sorting by
    mix_order gives the training order: block by block, each pass permuted anew.
    budget: tokens of the whole mixture; the corpus' own number if None."""
    columns = [c.lower() for c in docs.columns]
    inner_docs, restored = sealed(docs)
    named = {c: F.col(f"in{columns.index(c)}") for c in ("doc_id", "source", "text")}
    text = F.coalesce(named["text"], F.lit(""))
    own = inner_docs.select(
        "*",
        named["doc_id"].alias("doc_id"),
        F.coalesce(named["doc_id"].cast("string"), F.concat(F.lit("t"), F.md5(text))).alias("mix_id"),
        token_count(text).alias("mix_tokens"),
        F.coalesce(F.concat(F.lit("s"), named["source"]), F.lit("n")).alias("mix_key"),
        F.md5(text).alias("mix_text"),
    )
    placed = own.withColumn("h", _hash32(F.lit("d"), F.col("mix_id"))).withColumn("b", _hash32(F.lit("b"), F.col("mix_id")))
    stats = Kept(placed.select("mix_key", "doc_id", "mix_tokens", "mix_text", "h", "b"), "tokens")
    sources = Kept(source_tokens(stats.df), "sources").df
    total, n = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    budget = total if budget is None else budget
    a = exponent(sources, total, budget, n, entropy_ratio, max_repeats) if total and budget else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    plan = (
        sources.withColumn("weight", power / F.lit(z))
        .withColumn("share", F.floor(F.col("weight") * F.lit(float(budget))).cast("long"))
        .withColumn("whole", F.floor(F.col("share") / F.col("tokens")).cast("long"))
        .withColumn("rest", F.col("share") - F.col("whole") * F.col("tokens"))
        .withColumn("n_blocks", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long"))
        .select("mix_key", "whole", "rest", "n_blocks")
    )
    bounds = Kept(_bounds(stats.df.join(plan, "mix_key").withColumn("mix_block", F.pmod("b", "n_blocks"))), "bounds").df
    stats.drop()
    rows = placed.join(plan.select("mix_key", "whole", "n_blocks"), "mix_key").withColumn("mix_block", F.pmod("b", "n_blocks"))
    joined = rows.join(bounds, ["mix_key", "mix_block"])
    here = _place()
    # Null ids sort first in windows and in structs alike.
    within = F.coalesce(here < F.col("limit"), F.lit(False)) | (F.col("limit").isNotNull() & here.eqNullSafe(F.col("limit")))
    partial = F.when(F.col("room") >= F.col("t"), F.col("room") > 0).when(F.col("room") > 0, within).otherwise(F.lit(False))
    joined = joined.withColumn("partial", partial)
    if not bounds.filter("fit < equal").isEmpty():
        # Only so many of the equal rows at a limit fit; any of them will do.
        tie = F.coalesce((F.col("room") < F.col("t")) & (F.col("fit") < F.col("equal")) & here.eqNullSafe(F.col("limit")), F.lit(False))
        rest = F.to_json(F.struct(*(F.col(f"in{k}") for k, c in enumerate(columns) if c != "text")))
        turn = F.row_number().over(Window.partitionBy("mix_key", "mix_block").orderBy(rest))
        joined = joined.filter(~tie).union(joined.filter(tie).withColumn("partial", turn <= F.col("fit")))
    out = joined.withColumn("_passes", F.col("whole") + F.col("partial").cast("long")).filter("_passes > 0")
    out = out.withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)))
    key = F.concat_ws("-", F.md5(_block_key(F.col("mix_pass"))), F.md5(F.concat_ws(":", F.lit(SEED), F.lit("o"), F.col("mix_pass"), F.col("mix_id"))))
    return out.withColumn("mix_order", key).select(*restored, "mix_tokens", "mix_pass", "mix_block", "mix_order")


def _place() -> Column:
    """A row's place in its block's order; equal places are equal ids and texts."""
    return F.struct("h", "doc_id", "mix_tokens", "mix_text")


def _bounds(placed: DataFrame) -> DataFrame:
    """For each block its tokens `t`, the `room` that the partial pass has when it
    comes to the block, and, where it ends inside, the last place taken (`limit`),
    how many rows stand there (`equal`) and how many of them fit."""
    sums = placed.groupBy("mix_key", "mix_block").agg(F.sum("mix_tokens").alias("t"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    # The partial pass takes blocks in the order of that pass' permutation.
    sums = sums.withColumn("o", F.md5(_block_key(F.col("whole")))).withColumn("g", F.substring("o", 1, 3))
    sums = Kept(sums, "blocks").df
    so_far = lambda w: F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_group = sums.groupBy("mix_key", "g").agg(F.sum("t").alias("t"))
    before = by_group.select("mix_key", "g", so_far(Window.partitionBy("mix_key").orderBy("g")).alias("before"))
    within = so_far(Window.partitionBy("mix_key", "g").orderBy("o", "mix_block"))
    cut = sums.join(before, ["mix_key", "g"]).withColumn("room", F.col("rest") - F.col("before") - within)
    cut = cut.select("mix_key", "mix_block", "t", F.greatest("room", F.lit(0)).alias("room"))
    # Boundary blocks: the documents that still fit, in the block's own order.
    edge = cut.filter("room > 0 AND room < t").select("mix_key", "mix_block", "room")
    places = placed.join(edge, ["mix_key", "mix_block"]).groupBy("mix_key", "mix_block", "room", "h", "doc_id", "mix_tokens", "mix_text").agg(F.count("*").alias("equal"))
    inner = Window.partitionBy("mix_key", "mix_block").orderBy("h", "doc_id", "mix_tokens", "mix_text").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("room") - F.sum(F.col("mix_tokens") * F.col("equal")).over(inner) + F.col("mix_tokens") * F.col("equal")
    fit = F.when(F.col("mix_tokens") == 0, F.when(F.col("left") >= 0, F.col("equal"))).otherwise(F.least(F.floor(F.col("left") / F.col("mix_tokens")), F.col("equal")))
    taken = places.withColumn("left", left).withColumn("fit", fit.cast("long")).filter("fit > 0")
    last = taken.groupBy("mix_key", "mix_block").agg(F.max(F.struct(_place().alias("limit"), "equal", "fit")).alias("last")).select("mix_key", "mix_block", "last.*")
    return cut.join(last, ["mix_key", "mix_block"], "left")


def _block_key(n: Column) -> Column:
    return F.concat_ws(":", F.lit(SEED), F.lit("p"), n, F.col("mix_key"), F.col("mix_block"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return realise(docs).select("doc_id", "source", "mix_tokens", "mix_pass", "mix_block", "mix_order")


QUERIES = {"op9_mixing": op9_mixing}
_H = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
ORACLES = {
    "op9_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))) AS i, md5(coalesce(text, '')) AS m,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS BIGINT) AS t FROM documents),
s AS (SELECT k, CAST(sum(t) AS BIGINT) AS tokens FROM d GROUP BY k HAVING sum(t) > 0),
tot AS (SELECT CAST(sum(tokens) AS BIGINT) AS total, count(*) AS n, list(tokens / (SELECT sum(tokens) FROM s)) AS q FROM s),
e AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, q, {ENTROPY_RATIO} * ln(n) - 1e-12 AS target FROM tot
  UNION ALL SELECT step + 1, CASE WHEN g THEN m ELSE lo END, CASE WHEN g THEN hi ELSE m END, q, target FROM
    (SELECT *, (lo + hi) / 2 AS m, ln(list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2))))
      - list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2) * (lo + hi) / 2 * ln(x))) / list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2))) >= target AS g
     FROM e WHERE step < 24)),
r AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, q FROM tot
  UNION ALL SELECT step + 1, CASE WHEN g THEN lo ELSE m END, CASE WHEN g THEN m ELSE hi END, q FROM
    (SELECT *, (lo + hi) / 2 AS m, list_max(list_transform(q, lambda x: pow(x, (lo + hi) / 2 - 1))) / list_sum(list_transform(q, lambda x: pow(x, (lo + hi) / 2))) <= {MAX_REPEATS} AS g
     FROM r WHERE step < 24)),
a AS (SELECT greatest(
    (SELECT CASE WHEN -list_sum(list_transform(q, lambda x: x * ln(x))) >= {ENTROPY_RATIO} * ln(n) - 1e-12 THEN 1.0 ELSE (SELECT lo FROM e WHERE step = 24) END FROM tot),
    (SELECT CASE WHEN list_max(list_transform(q, lambda x: 1 / x)) / n <= {MAX_REPEATS} THEN 0.0 ELSE (SELECT hi FROM r WHERE step = 24) END FROM tot)) AS a),
z AS (SELECT a, total, (SELECT sum(pow(tokens / total, a)) FROM s) AS z FROM a, tot),
p AS (SELECT k, tokens, CAST(floor(pow(tokens / total, a) / z * total) AS BIGINT) AS share, CAST(ceil(tokens / {BLOCK_TOKENS}) AS BIGINT) AS nb FROM s, z),
p2 AS (SELECT *, share // tokens AS whole, share - (share // tokens) * tokens AS rest FROM p),
b AS (SELECT d.*, whole, rest, {_H.format(f"'{SEED}:b:' || i")} % nb AS block, {_H.format(f"'{SEED}:d:' || i")} AS h FROM d JOIN p2 ON d.k = p2.k),
c AS (SELECT k, block, any_value(whole) AS whole, any_value(rest) AS rest, sum(t) AS bt FROM b GROUP BY k, block),
c2 AS (SELECT k, block, bt, rest - (sum(bt) OVER (PARTITION BY k ORDER BY md5('{SEED}:p:' || whole || ':' || k || ':' || block), block ROWS UNBOUNDED PRECEDING) - bt) AS room FROM c),
f AS (SELECT b.*, bt, room, sum(t) OVER (PARTITION BY b.k, b.block ORDER BY h, doc_id NULLS FIRST, t, m ROWS UNBOUNDED PRECEDING) AS upto FROM b JOIN c2 ON b.k = c2.k AND b.block = c2.block),
x AS (SELECT *, whole + CASE WHEN room >= bt AND room > 0 THEN 1 WHEN room > 0 AND upto <= room THEN 1 ELSE 0 END AS passes FROM f),
y AS (SELECT *, unnest(range(CAST(passes AS BIGINT))) AS pass FROM x WHERE passes > 0)
SELECT doc_id, source, t AS mix_tokens, pass AS mix_pass, block AS mix_block,
    md5('{SEED}:p:' || pass || ':' || k || ':' || block) || '-' || md5('{SEED}:o:' || pass || ':' || i) AS mix_order FROM y
"""
}
