"""Signal queries over `events`. The bands are placeholders for the fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.functions.dates import parse_date
from sigloom.operators import signals as S
from sigloom.operators import slices
from sigloom.operators import tables as O
from sigloom.operators.layouts import BASELINE, COMPACT, conform
from sigloom.plans.catalog import register
from sigloom.sources.tables import table, table_as_of

LO, HI, FALL, RISE, HOLD = -0.1, 0.1, -0.3, 0.5, 3


def _returns(spark, sf_dir):
    return S.simple_return(S.daily_panel(table(spark, sf_dir, "events"), "event_type", "ts", "value"))


def _states(spark, sf_dir):
    return _returns(spark, sf_dir).withColumn("state", S.three_state(F.col("ret"), LO, HI))


_PANEL = """SELECT event_type AS key, CAST(ts AS DATE) AS dt,
  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total FROM events GROUP BY 1, 2"""
_RET = f"""SELECT *, CASE WHEN lag(CAST(total AS DOUBLE)) OVER w <> 0
  THEN CAST(total AS DOUBLE) / lag(CAST(total AS DOUBLE)) OVER w - 1 END AS ret
  FROM ({_PANEL}) WINDOW w AS (PARTITION BY key ORDER BY dt)"""
_STATE = f"""SELECT key, dt, CAST(CASE WHEN ret IS NULL THEN NULL WHEN ret > {HI} THEN 1
  WHEN ret < {LO} THEN -1 ELSE 0 END AS INTEGER) AS state FROM ({_RET})"""


@register("daily_panel", _PANEL)
def daily_panel(spark, sf_dir):
    return S.daily_panel(table(spark, sf_dir, "events"), "event_type", "ts", "value")


@register("three_state", _STATE)
def three_state(spark, sf_dir):
    return _states(spark, sf_dir).select("key", "dt", "state")


@register("large_move", f"""SELECT key, dt, CASE WHEN ret >= {RISE} THEN 'rise' WHEN ret <= {FALL} THEN 'fall' ELSE 'none' END AS move FROM ({_RET})""")
def large_move(spark, sf_dir):
    return _returns(spark, sf_dir).select("key", "dt", S.large_move(F.col("ret"), FALL, RISE).alias("move"))


_SEG = f"""SELECT key, seg, any_value(state) AS state, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS n_days FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY key ORDER BY dt) AS BIGINT) AS seg FROM (
    SELECT *, CASE WHEN row_number() OVER w = 1 OR state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS new
    FROM ({_STATE}) WINDOW w AS (PARTITION BY key ORDER BY dt))) GROUP BY key, seg"""


@register("state_segments", _SEG)
def state_segments(spark, sf_dir):
    return S.segments(_states(spark, sf_dir))


@register("sign_reversal", f"""SELECT key, dt, state, prev_state FROM (SELECT *, lag(state) OVER (PARTITION BY key ORDER BY dt) AS prev_state
  FROM ({_STATE})) WHERE state * prev_state = -1""")
def sign_reversal(spark, sf_dir):
    return S.reversals(_states(spark, sf_dir)).select("key", "dt", "state", "prev_state")


@register("zero_segment_reversal", f"""SELECT key, start_dt, end_dt, n_days, before, after FROM (SELECT *, lag(state) OVER w AS before, lead(state) OVER w AS after
  FROM ({_SEG}) WINDOW w AS (PARTITION BY key ORDER BY seg)) WHERE state = 0 AND before * after = -1""")
def zero_segment_reversal(spark, sf_dir):
    return S.zero_segment_reversals(_states(spark, sf_dir)).select("key", "start_dt", "end_dt", "n_days", "before", "after")


@register("nonzero_exit", f"""SELECT key, dt, state, prev_state FROM (SELECT *, lag(state) OVER (PARTITION BY key ORDER BY dt) AS prev_state
  FROM ({_STATE})) WHERE prev_state <> 0 AND state <> prev_state""")
def nonzero_exit(spark, sf_dir):
    return S.nonzero_exits(_states(spark, sf_dir)).select("key", "dt", "state", "prev_state")


@register("execution_date", "SELECT dt, lead(dt) OVER (ORDER BY dt) AS execution_dt FROM (SELECT DISTINCT CAST(ts AS DATE) AS dt FROM events)")
def execution_date(spark, sf_dir):
    return S.execution_dates(table(spark, sf_dir, "events").select(F.to_date("ts").alias("dt")))


@register("holding_period", f"""WITH RECURSIVE s AS (SELECT key, dt, coalesce(state, 0) AS state, row_number() OVER (PARTITION BY key ORDER BY dt) AS i FROM ({_STATE})),
f AS (SELECT key, dt, i, CAST(state AS INTEGER) AS position, CAST(CASE WHEN state <> 0 THEN 1 ELSE 0 END AS INTEGER) AS age FROM s WHERE i = 1
  UNION ALL SELECT s.key, s.dt, s.i,
    CAST(CASE WHEN f.position <> 0 AND f.age < {HOLD} THEN f.position ELSE s.state END AS INTEGER),
    CAST(CASE WHEN f.position <> 0 AND f.age < {HOLD} THEN f.age + 1 WHEN s.state <> 0 THEN 1 ELSE 0 END AS INTEGER)
  FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1)
SELECT key, dt, position, age FROM f""")
def holding_period(spark, sf_dir):
    return S.holding_positions(_states(spark, sf_dir), HOLD)


def _signals(spark, sf_dir):
    st = _states(spark, sf_dir)
    return {
        "state": st.select("key", "dt", "state").withColumnRenamed("state", "value"),
        "reversal": S.reversals(st).select("key", "dt", F.col("state").alias("value")),
        "exit_from": S.nonzero_exits(st).select("key", "dt", F.col("prev_state").alias("value")),
        "position": S.holding_positions(st, HOLD).select("key", "dt", F.col("position").alias("value")),
    }


_MERGE = """WITH RECURSIVE st AS MATERIALIZED ({state}), pos AS ({hold})
SELECT st.key, st.dt, st.state, r.state AS reversal, e.prev_state AS exit_from, pos.position FROM st
LEFT JOIN (SELECT key, dt, state FROM (SELECT *, lag(state) OVER (PARTITION BY key ORDER BY dt) AS p FROM st) WHERE state * p = -1) r ON r.key = st.key AND r.dt = st.dt
LEFT JOIN (SELECT key, dt, p AS prev_state FROM (SELECT *, lag(state) OVER (PARTITION BY key ORDER BY dt) AS p FROM st) WHERE p <> 0 AND state <> p) e ON e.key = st.key AND e.dt = st.dt
LEFT JOIN pos ON pos.key = st.key AND pos.dt = st.dt"""


def _hold_sql():
    from sigloom.plans.catalog import _ORACLES

    return _ORACLES["holding_period"]


@register("four_signal_merge", _MERGE.format(state=_STATE, hold=_hold_sql()))
def four_signal_merge(spark, sf_dir):
    return O.merge_signals(_signals(spark, sf_dir), ["key", "dt"], "value")


@register("signal_statistics", f"""SELECT key, state, count(*) AS n_days, grouping(key) + grouping(state) AS level FROM ({_STATE}) GROUP BY ROLLUP (key, state)""")
def signal_statistics(spark, sf_dir):
    return _states(spark, sf_dir).rollup("key", "state").agg(F.count("*").alias("n_days"), (F.grouping("key") + F.grouping("state")).cast("long").alias("level"))


@register("delayed_reversal", f"""SELECT key, dt, state, prev_state FROM (SELECT *, last_value(nullif(state, 0) IGNORE NULLS) OVER (PARTITION BY key ORDER BY dt
  ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prev_state FROM ({_STATE})) WHERE state * prev_state = -1""")
def delayed_reversal(spark, sf_dir):
    return S.delayed_reversals(_states(spark, sf_dir), 5).select("key", "dt", "state", "prev_state")


@register("confirmed_reversal", f"""SELECT key, dt, state, prev_state FROM (SELECT *, lag(state) OVER (PARTITION BY key ORDER BY dt) AS prev_state, lead(state) OVER (PARTITION BY key ORDER BY dt) AS next_state
  FROM ({_STATE})) WHERE state * prev_state = -1 AND next_state = state""")
def confirmed_reversal(spark, sf_dir):
    return S.confirmed_reversals(_states(spark, sf_dir), 2).select("key", "dt", "state", "prev_state")


@register("mechanism_transitions", f"""SELECT key, prev_state, state, count(*) AS n_days, round(count(*) / sum(count(*)) OVER (PARTITION BY key, prev_state), 9) AS share FROM (
  SELECT *, lag(state) OVER (PARTITION BY key ORDER BY dt) AS prev_state FROM ({_STATE})) WHERE state IS NOT NULL AND prev_state IS NOT NULL GROUP BY key, prev_state, state""")
def mechanism_transitions(spark, sf_dir):
    """How often each state follows each."""
    return S.transitions(_states(spark, sf_dir)).withColumn("share", F.round("share", 9))


@register("mechanism_durations", f"""SELECT key, state, count(*) AS n_segments, CAST(sum(n_days) AS BIGINT) AS n_days, max(n_days) AS longest, round(avg(n_days), 9) AS mean_days FROM ({_SEG}) WHERE state IS NOT NULL GROUP BY key, state""")
def mechanism_durations(spark, sf_dir):
    """How long states last."""
    seg = S.segments(_states(spark, sf_dir)).filter("state IS NOT NULL")
    return seg.groupBy("key", "state").agg(F.count("*").alias("n_segments"), F.sum("n_days").alias("n_days"), F.max("n_days").alias("longest"), F.round(F.avg("n_days"), 9).alias("mean_days"))


@register("mechanism_reversals", f"""SELECT key, state, count(*) AS n_reversals, round(avg(next_ret), 8) AS mean_next FROM (SELECT s.*, lag(s.state) OVER (PARTITION BY s.key ORDER BY s.dt) AS p,
  lead(r.ret) OVER (PARTITION BY s.key ORDER BY s.dt) AS next_ret FROM ({_STATE}) s JOIN ({_RET}) r ON r.key = s.key AND r.dt = s.dt) WHERE state * p = -1 GROUP BY key, state""")
def mechanism_reversals(spark, sf_dir):
    """What follows a reversal."""
    from pyspark.sql import Window

    df = _states(spark, sf_dir).withColumn("next_ret", F.lead("ret").over(Window.partitionBy("key").orderBy("dt")))
    return S.reversals(df).groupBy("key", "state").agg(F.count("*").alias("n_reversals"), F.round(F.avg("next_ret"), 8).alias("mean_next"))


def _diagnostic(spark, sf_dir):
    """Nine columns for each key and day: the panel with all signals beside it."""
    st = S.numbered_segments(_states(spark, sf_dir))
    flags = _signals(spark, sf_dir)
    out = st.withColumn("prev_state", S.lagged_state())
    for name in ("reversal", "exit_from"):
        out = out.join(flags[name].withColumnRenamed("value", name), ["key", "dt"], "left")
    return out


_DIAGNOSTIC = f"""SELECT key, dt, total, ret, state, prev_state, CAST(sum(new) OVER (PARTITION BY key ORDER BY dt) AS BIGINT) AS seg,
  CASE WHEN state * prev_state = -1 THEN state END AS reversal, CASE WHEN prev_state <> 0 AND state <> prev_state THEN prev_state END AS exit_from FROM (
  SELECT r.key, r.dt, r.total, r.ret, s.state, lag(s.state) OVER w AS prev_state, CASE WHEN row_number() OVER w = 1 OR s.state IS DISTINCT FROM lag(s.state) OVER w THEN 1 ELSE 0 END AS new
  FROM ({_RET}) r JOIN ({_STATE}) s ON s.key = r.key AND s.dt = r.dt WINDOW w AS (PARTITION BY s.key ORDER BY s.dt))"""


@register("diagnostic_panel", _DIAGNOSTIC)
def diagnostic_panel(spark, sf_dir):
    """In the nine-column layout."""
    return conform(_diagnostic(spark, sf_dir), BASELINE)


@register("compact_layout", f"""WITH RECURSIVE pos AS ({_hold_sql()}), cal AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS execution_dt FROM (SELECT DISTINCT CAST(ts AS DATE) AS dt FROM events))
  SELECT r.key, r.dt, cal.execution_dt, r.total, r.ret, s.state, pos.position, pos.age FROM ({_RET}) r JOIN ({_STATE}) s ON s.key = r.key AND s.dt = r.dt
  JOIN pos ON pos.key = r.key AND pos.dt = r.dt JOIN cal ON cal.dt = r.dt""")
def compact_layout(spark, sf_dir):
    """Eight columns: the panel with its execution date and position."""
    st = _states(spark, sf_dir)
    days = execution_date(spark, sf_dir)
    return conform(st.join(S.holding_positions(st, HOLD), ["key", "dt"]).join(days, "dt"), COMPACT)


@register("mechanism_table", f"""SELECT key, state, count(*) AS n_days, round(avg(next_ret), 8) AS mean_next, CAST(sum(CASE WHEN next_ret > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_up FROM (
  SELECT r.key, r.dt, s.state, lead(r.ret) OVER (PARTITION BY r.key ORDER BY r.dt) AS next_ret FROM ({_RET}) r JOIN ({_STATE}) s ON r.key = s.key AND r.dt = s.dt)
  WHERE state IS NOT NULL AND next_ret IS NOT NULL GROUP BY key, state""")
def mechanism_table(spark, sf_dir):
    from pyspark.sql import Window

    df = _states(spark, sf_dir).withColumn("next_ret", F.lead("ret").over(Window.partitionBy("key").orderBy("dt")))
    df = df.filter("state IS NOT NULL AND next_ret IS NOT NULL")
    return df.groupBy("key", "state").agg(F.count("*").alias("n_days"), F.round(F.avg("next_ret"), 8).alias("mean_next"), F.sum((F.col("next_ret") > 0).cast("long")).alias("n_up"))


@register("candidate_pool", f"""SELECT key, dt, ret, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ret DESC NULLS LAST, dt) AS rank FROM ({_RET})) WHERE rank <= 5""")
def candidate_pool(spark, sf_dir):
    return O.top_k(_returns(spark, sf_dir).select("key", "dt", "ret"), "key", [F.col("ret").desc_nulls_last(), F.col("dt")], 5)


@register("panel_parity", f"""SELECT key, dt, CAST(1 AS INTEGER) AS copy, CASE WHEN key = 'click' THEN 'missing_right' ELSE 'total' END AS difference FROM ({_PANEL})
  WHERE dt = DATE '2024-01-05' AND key IN ('click', 'view')""")
def panel_parity(spark, sf_dir):
    """The panel against a copy with one row missing and one value changed."""
    a = daily_panel(spark, sf_dir)
    b = a.filter("NOT (key = 'click' AND dt = DATE '2024-01-05')").withColumn("total", F.when(F.expr("key = 'view' AND dt = DATE '2024-01-05'"), F.col("total") + 1).otherwise(F.col("total")).cast("decimal(38,2)"))
    return O.parity(a, b, ["key", "dt"])


@register("parity_verdicts", f"""SELECT 'panel' AS "table", CAST(0 AS BIGINT) AS differences, 'PASS' AS verdict
  UNION ALL SELECT 'broken', count(*) FILTER (WHERE key = 'click'), CASE WHEN count(*) FILTER (WHERE key = 'click') = 0 THEN 'PASS' ELSE 'FAIL' END FROM ({_PANEL})""")
def parity_verdicts(spark, sf_dir):
    a = daily_panel(spark, sf_dir)
    return O.parity_report({"panel": (a, a, ["key", "dt"]), "broken": (a, a.filter("key <> 'click'"), ["key", "dt"])})


@register("multiset_parity", f"""WITH a AS ({_STATE}), l AS (SELECT key, state FROM a), r AS (SELECT key, state FROM a WHERE dt > DATE '2024-01-10' UNION ALL SELECT key, state FROM a WHERE dt > DATE '2024-01-25')
  SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def multiset_parity(spark, sf_dir):
    """EXCEPT ALL both ways: the later states, some of them twice, against all."""
    a = _states(spark, sf_dir)
    pick = lambda day: a.filter(F.col("dt") > F.lit(day).cast("date")).select("key", "state")
    return O.multiset_parity(a.select("key", "state"), pick("2024-01-10").union(pick("2024-01-25")))


@register("daily_parity", f"""SELECT dt, CAST(count(*) FILTER (WHERE key = 'click' AND day(dt) <= 3) AS BIGINT) AS differences FROM ({_PANEL}) GROUP BY dt""")
def daily_parity(spark, sf_dir):
    a = daily_panel(spark, sf_dir)
    return O.daily_parity(a, a.filter("NOT (key = 'click' AND day(dt) <= 3)"), ["key", "dt"], "dt")


@register("date_parse", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS dt FROM orders""")
def date_parse(spark, sf_dir):
    """Three layouts and a bad one, back to dates."""
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 2 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE 'n/a' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_date(text, ("yyyy-MM-dd", "yyyyMMdd", "dd/MM/yyyy")).alias("dt"))


@register("dense_calendar", """WITH p AS (SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS dt, count(*) AS n FROM orders GROUP BY 1, 2),
g AS (SELECT key, CAST(d AS DATE) AS dt FROM (SELECT DISTINCT key FROM p), (SELECT unnest(generate_series((SELECT min(dt) FROM p)::TIMESTAMP, (SELECT max(dt) FROM p)::TIMESTAMP, INTERVAL 1 DAY)) AS d))
SELECT g.key, g.dt, last_value(n IGNORE NULLS) OVER (PARTITION BY g.key ORDER BY g.dt ROWS UNBOUNDED PRECEDING) AS n FROM g LEFT JOIN p ON g.key = p.key AND g.dt = p.dt""")
def dense_calendar(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("dt")).agg(F.count("*").alias("n"))
    return O.densify(p, "key", "dt", "n")


@register("daily_ohlc", """SELECT event_type AS key, CAST(ts AS DATE) AS dt, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1, 2""")
def daily_ohlc(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("dt")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close")
    )


@register("drawdown", """SELECT event_id, round(value - max(value) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS drawdown FROM events""")
def drawdown(spark, sf_dir):
    """Five keys hold all rows: the running maximum goes by slices of a day."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    top = slices.running_max(e, "event_type", "ts", ["ts"], "value", "top", 86400)
    return top.select("event_id", F.round(F.col("value") - F.col("top"), 6).alias("drawdown"))


@register("asof_ingest", "SELECT event_type, count(*) AS n, max(CAST(ts AS DATE)) AS last_day FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY event_type")
def asof_ingest(spark, sf_dir):
    e = table_as_of(spark, sf_dir, "events", "ts", "2024-01-15")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.to_date("ts")).alias("last_day"))


_DAILY_ORDERS = "SELECT o_orderpriority AS key, CAST(o_orderdate AS DATE) AS dt, CAST(CASE WHEN count(*) % 3 = 2 THEN -1 ELSE count(*) % 3 END AS INTEGER) AS state FROM orders GROUP BY 1, 2"


@register("holding_period_long", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT key, dt, state, row_number() OVER (PARTITION BY key ORDER BY dt) AS i FROM ({_DAILY_ORDERS})),
f AS (SELECT key, dt, i, state AS position, CAST(CASE WHEN state <> 0 THEN 1 ELSE 0 END AS INTEGER) AS age FROM s WHERE i = 1
  UNION ALL SELECT s.key, s.dt, s.i,
    CAST(CASE WHEN f.position <> 0 AND f.age < {HOLD} THEN f.position ELSE s.state END AS INTEGER),
    CAST(CASE WHEN f.position <> 0 AND f.age < {HOLD} THEN f.age + 1 WHEN s.state <> 0 THEN 1 ELSE 0 END AS INTEGER)
  FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1)
SELECT key, dt, position, age FROM f""")
def holding_period_long(spark, sf_dir):
    """Some 1,700 days a key: made-up states from the daily number of orders."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("dt")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n") % 3 == 2, -1).otherwise(F.col("n") % 3).cast("int")
    return S.holding_positions_long(n.withColumn("state", state), HOLD)
