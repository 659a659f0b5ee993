"""The relational catalogue: one query for each operator, in SQL over DataFrames.

Table names stand in braces; Spark gets the tables as arguments (no temporary
views), DuckDB the same text without braces unless it needs a dialect of its own.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from sigloom.operators import blocks, slices
from sigloom.operators import tables as O
from sigloom.plans.catalog import register
from sigloom.sources.tables import table

_NAME = re.compile(r"\{(\w+)\}")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    names = sorted(set(_NAME.findall(text)))

    def run(spark, sf_dir):
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    register(name, _NAME.sub(r"\1", oracle or text))(run)


# Projections, filters, predicates
_sql("filter_project", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'F')")
_sql("null_safe", "SELECT c.c_custkey, c.c_nationkey <=> n.n_nationkey AS same FROM {customer} c LEFT JOIN {nation} n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1",
     "SELECT c.c_custkey, c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey AS same FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1")
_sql("scalar_subquery", "SELECT o_orderkey FROM {orders} o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)")
_sql("exists_semi", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
_sql("lateral_top", "SELECT n_name, t.c_custkey FROM {nation} n, LATERAL (SELECT c_custkey FROM {customer} c WHERE c.c_nationkey = n.n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) t")

# Joins
_sql("join_inner", "SELECT n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
_sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 200000")
_sql("join_right", "SELECT o_orderkey, c_custkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_sql("join_full", "SELECT s_suppkey, c_custkey FROM {supplier} FULL JOIN {customer} ON s_suppkey = c_custkey + 50")
_sql("join_semi", "SELECT o_orderkey FROM {orders} LEFT SEMI JOIN {lineitem} ON o_orderkey = l_orderkey",
     "SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey")
_sql("join_anti", "SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey",
     "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
_sql("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
# Strategies: the hint decides, the rows are the same.
for _hint in ("MERGE", "SHUFFLE_HASH", "BROADCAST"):
    _sql(f"join_hint_{_hint.lower()}", f"SELECT /*+ {_hint}(c) */ o.o_orderkey, c.c_name FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey ",
         "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey ")


@register("join_hint_shuffle_replicate_nl", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def join_hint_shuffle_replicate_nl(spark, sf_dir):
    """The hint on blocks of rows: on rows the loop would take all pairs."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return blocks.replicate_join(orders, customers, "o_custkey", "c_custkey").select("o_orderkey", "c_name")


_sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")

# Aggregation
_sql("pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty,
  round(avg(l_discount), 9) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
_sql("count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM {orders} GROUP BY o_orderpriority")
_sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("agg_grouping_sets", "SELECT r_name, n_name, count(*) AS n FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (n_name), ())")
_sql("agg_percentile", "SELECT o_orderstatus, round(percentile(o_totalprice, 0.9), 6) AS p90, round(percentile(o_totalprice, 0.5), 6) AS median FROM {orders} GROUP BY o_orderstatus",
     "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders GROUP BY o_orderstatus")
_sql("agg_moments", "SELECT p_type, round(stddev_samp(p_retailprice), 5) AS sd, round(corr(p_size, p_retailprice), 7) AS r FROM {part} GROUP BY p_type")
_sql("agg_min_by", "SELECT c_nationkey, min_by(c_name, (c_acctbal, c_custkey)) AS poorest, max_by(c_name, (c_acctbal, c_custkey)) AS richest FROM {customer} GROUP BY c_nationkey".replace("(c_acctbal, c_custkey)", "struct(c_acctbal, c_custkey)"),
     "SELECT c_nationkey, arg_min(c_name, (c_acctbal, c_custkey)) AS poorest, arg_max(c_name, (c_acctbal, c_custkey)) AS richest FROM customer GROUP BY c_nationkey")
_sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 14")
_sql("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) AS n FROM {events} GROUP BY event_type")
_sql("pivot", "SELECT * FROM (SELECT CAST(ts AS DATE) AS dt, event_type FROM {events}) PIVOT (count(*) FOR event_type IN ('click' AS click, 'view' AS view, 'error' AS error))",
     "SELECT CAST(ts AS DATE) AS dt, nullif(count(*) FILTER (WHERE event_type = 'click'), 0) AS click, nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS view, nullif(count(*) FILTER (WHERE event_type = 'error'), 0) AS error FROM events GROUP BY 1")
_sql("unpivot", "SELECT s_suppkey, measure, amount FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM {supplier}) UNPIVOT (amount FOR measure IN (nation, balance))")

# Windows
_sql("ranking", """SELECT s_suppkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr,
  CAST(ntile(3) OVER w AS BIGINT) AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM {supplier} WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)""")
_sql("rolling_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS n6h FROM {events}")
_sql("lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
_sql("last_seen", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS bought FROM {events}",
     "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS bought FROM events")
_sql("tumbling_window", "SELECT window.start AS start, event_type, count(*) AS n FROM {events} GROUP BY window(ts, '1 hour'), event_type",
     "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_sql("session_windows", "SELECT user_id, session_window.start AS start, count(*) AS n FROM {events} GROUP BY user_id, session_window(ts, '6 hours')",
     """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
     SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")  # fmt: skip

# Sorting, limits, sets
_sql("top_orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
_sql("limit_offset", "SELECT p_partkey FROM {part} ORDER BY p_retailprice NULLS LAST, p_partkey LIMIT 20 OFFSET 10")
_sql("union_all", "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name AS name FROM {region}")
_sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
_sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}")
_sql("except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}")
_sql("distinct_pairs", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")

# Scalar functions
_sql("fn_string", "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n, upper(c_mktsegment) AS up, substring(c_name, 3, 4) AS mid, md5(c_name) AS hash, regexp_replace(c_name, '[0-9]', '#') AS masked FROM {customer}",
     "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n, upper(c_mktsegment) AS up, substring(c_name, 3, 4) AS mid, md5(c_name) AS hash, regexp_replace(c_name, '[0-9]', '#', 'g') AS masked FROM customer")
_sql("fn_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(weekday(o_orderdate) AS BIGINT) AS wd, CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM {orders}",
     "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS wd, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS days, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
_sql("fn_math", "SELECT p_partkey, round(p_retailprice / p_size, 6) AS per, p_partkey % 7 AS m, round(sqrt(p_retailprice), 6) AS root, CAST(floor(p_retailprice) AS BIGINT) AS fl FROM {part}")
_sql("fn_array", "SELECT o_custkey, n FROM (SELECT o_custkey, explode(slice(array_sort(collect_list(o_orderkey)), 1, 2)) AS n FROM {orders} GROUP BY o_custkey)",
     "SELECT o_custkey, unnest(list_slice(list_sort(list(o_orderkey)), 1, 2)) AS n FROM orders GROUP BY o_custkey")
_sql("fn_json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_sql("fn_conditional", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS status, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority FROM {orders}")
_sql("fn_map", """SELECT o_custkey, map_contains_key(m, 'O') AS has_open, element_at(m, 'F') AS filled, CAST(size(map_filter(m, (k, v) -> v > 3)) AS BIGINT) AS often,
  aggregate(map_values(m), 0L, (a, v) -> a + v) AS n FROM (SELECT o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) AS m
  FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_custkey, o_orderstatus) GROUP BY o_custkey)""",
     """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') > 0 AS has_open, CAST(sum(n) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS filled,
  count(*) FILTER (WHERE n > 3) AS often, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey""")  # fmt: skip
_sql("fn_variant", "SELECT event_id, variant_get(v, '$.k', 'int') AS k, try_variant_get(v, '$.none', 'string') AS none, is_variant_null(variant_get(v, '$.k')) AS is_null FROM (SELECT event_id, parse_json(props) AS v FROM {events})",
     "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.none') AS none, json_extract_string(props, '$.k') IS NULL AS is_null FROM events")
_sql("fn_interval", """SELECT o_orderkey, o_orderdate + make_dt_interval(o_orderkey % 3, 5, 30) AS due, o_orderdate + make_ym_interval(0, 2) AS later,
  CAST(extract(DAY FROM TIMESTAMP_NTZ '2002-01-01 00:00:00' - o_orderdate) AS BIGINT) AS days_left FROM {orders}""",
     """SELECT o_orderkey, o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) + INTERVAL 330 MINUTE AS due, o_orderdate + INTERVAL 2 MONTH AS later,
  datediff('day', o_orderdate, TIMESTAMP '2002-01-01 00:00:00') - CASE WHEN CAST(o_orderdate AS TIME) > TIME '00:00:00' THEN 1 ELSE 0 END AS days_left FROM orders""")  # fmt: skip
_sql("recursive_dates", "WITH RECURSIVE d(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM d WHERE n < 60) SELECT n, count(*) AS orders FROM d JOIN {orders} ON o_custkey = n GROUP BY n")

# Longer queries
_sql("market_share", """SELECT n_name, year(o_orderdate) AS y, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS revenue
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  WHERE r_name = 'ASIA' GROUP BY n_name, year(o_orderdate)""",
     """SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(38,4)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE r_name = 'ASIA' GROUP BY 1, 2""")  # fmt: skip
_sql("shipping_priority", """SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue, o_orderdate FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
  WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")


@register("as_of_join", """SELECT e.event_id, max(p.event_id) AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
  LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON p.user_id = e.user_id AND p.ts <= e.ts GROUP BY e.event_id""")
def as_of_join(spark, sf_dir):
    """Each purchase with the user's last view (ids follow time here)."""
    e = table(spark, sf_dir, "events")
    bought, seen = e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'")
    return O.as_of(bought.select("event_id", "user_id", "ts"), seen, "user_id", "ts", "ts", ["event_id"]).select("event_id", "asof_event_id")


@register("interval_join", """SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id
  AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'error' AND b.event_type = 'click'""")
def interval_join(spark, sf_dir):
    """Clicks within 30 minutes after an error of the same user: the time axis is
    cut into buckets of the interval, so both sides meet by equality and a hot
    user is spread over its buckets."""
    e = table(spark, sf_dir, "events")
    step = 1800
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    a = e.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("from_ts"), F.explode(F.array(F.floor(at / step), F.floor(at / step) + 1)).alias("bucket"))
    b = e.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", "ts", F.floor(at / step).alias("bucket"))
    near = (F.col("ts") >= F.col("from_ts")) & (F.col("ts") <= F.col("from_ts") + F.expr("INTERVAL 30 MINUTES"))
    return a.join(b, ["user_id", "bucket"]).filter(near).select("error_id", "click_id")


@register("udf_scalar", "SELECT c_custkey, round(c_acctbal * 1.1, 6) AS raised FROM customer")
def udf_scalar(spark, sf_dir):
    """A vectorised scalar function."""

    @F.pandas_udf("double")
    def raised(s: pd.Series) -> pd.Series:
        return s * 1.1

    return table(spark, sf_dir, "customer").select("c_custkey", F.round(raised("c_acctbal"), 6).alias("raised"))


@register("udf_grouped", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 6) AS spread FROM customer GROUP BY c_nationkey")
def udf_grouped(spark, sf_dir):
    """A vectorised aggregate function."""

    @F.pandas_udf("double")
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 6).alias("spread"))


@register("udtf_words", "SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def udtf_words(spark, sf_dir):
    """A table function, called laterally."""

    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for word in text.split(" "):
                yield (word,)

    spark.udtf.register("sigloom_words", Words)
    return spark.sql("SELECT p_partkey, w.word FROM {part}, LATERAL sigloom_words(p_name) w", part=table(spark, sf_dir, "part"))


@register("rolling_rows", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean10 FROM events")
def rolling_rows(spark, sf_dir):
    """Five keys hold all rows: they are cut into chunks."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return slices.rolling_rows(e, "event_type", "ts", ["ts"], 10, F.avg("value"), "mean10", 86400).select("event_id", F.round("mean10", 6).alias("mean10"))


@register("agg_approx_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, true AS within FROM orders GROUP BY o_orderpriority")
def agg_approx_distinct(spark, sf_dir):
    """The sketch (relative error 0.01) beside the exact count; `within` says that
    it lies in four standard errors."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority")
    rough = F.approx_count_distinct("o_custkey", 0.01)
    exact = F.count_distinct("o_custkey")
    return o.agg(exact.alias("customers"), (F.abs(rough - exact) <= 0.04 * exact).alias("within"))


@register("fn_time", """SELECT event_id, CAST(date_part('hour', CAST(ts AS TIME)) AS INTEGER) AS h, CAST(date_part('minute', CAST(ts AS TIME)) AS INTEGER) AS m,
  CAST(ts AS TIME) < TIME '12:00:00' AS morning FROM events""")
def fn_time(spark, sf_dir):
    """The TIME type, which this version of Spark has behind a setting."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return spark.sql(
        "SELECT event_id, hour(t) AS h, minute(t) AS m, t < TIME '12:00:00' AS morning FROM (SELECT event_id, to_time(date_format(ts, 'HH:mm:ss')) AS t FROM {events})",
        events=table(spark, sf_dir, "events"),
    )
