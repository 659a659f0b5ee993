"""Runs, stored results, layouts of files and reports, each as a query: what was
written to the shared folder is what comes back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sigloom.plans import package, reports
from sigloom.plans import signal_queries as Q
from sigloom.plans.catalog import register
from sigloom.sources import embedded, formats
from sigloom.sources.scratch import fresh_dir
from sigloom.sources.tables import read_result, table, write_result

STEPS = [("daily_panel", Q.daily_panel), ("three_state", Q.three_state), ("state_segments", Q.state_segments)]


@register("rebuild_panel", Q._PANEL)
def rebuild_panel(spark, sf_dir):
    """The panel that a run built from its one input and wrote to its place."""
    out = fresh_dir(spark, "run")
    package.run_package(spark, sf_dir, out, "today", STEPS[:1])
    return read_result(spark, out, "today", "daily_panel")


@register("package_run", f"""SELECT CAST(0 AS INTEGER) AS step, 'daily_panel' AS name, count(*) AS n_rows FROM ({Q._PANEL})
  UNION ALL SELECT 1, 'three_state', count(*) FROM ({Q._STATE}) UNION ALL SELECT 2, 'state_segments', count(*) FROM ({Q._SEG})""")
def package_run(spark, sf_dir):
    """An ordered run: what each step, in its turn, left at the agreed place."""
    out = fresh_dir(spark, "run")
    done = list(package.run_package(spark, sf_dir, out, "today", STEPS))
    counts = [read_result(spark, out, "today", n).agg(F.lit(k).alias("step"), F.lit(n).alias("name"), F.count("*").alias("n_rows")) for k, n in enumerate(done)]
    return counts[0].union(counts[1]).union(counts[2])


@register("golden_check", f"""SELECT 'daily_panel' AS "table", count(*) FILTER (WHERE key = 'click' AND day(dt) <= 3) AS differences,
  CASE WHEN count(*) FILTER (WHERE key = 'click' AND day(dt) <= 3) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ({Q._PANEL})
  UNION ALL SELECT 'three_state', CAST(0 AS BIGINT), 'PASS'""")
def golden_check(spark, sf_dir):
    """A run against a stored one, whose panel has other totals on some days."""
    out = fresh_dir(spark, "run")
    changed = F.when(F.expr("key = 'click' AND day(dt) <= 3"), F.col("total") + 1).otherwise(F.col("total")).cast("decimal(38,2)")
    package.run_package(spark, sf_dir, out, "golden", [("daily_panel", lambda s, d: Q.daily_panel(s, d).withColumn("total", changed)), STEPS[1]])
    return package.run_and_check(spark, sf_dir, out, "today", "golden", STEPS[:2], {"daily_panel": ["key", "dt"], "three_state": ["key", "dt"]})


@register("golden_daily_check", f"""SELECT dt, count(*) FILTER (WHERE key = 'click' AND day(dt) <= 3) AS differences FROM ({Q._PANEL}) GROUP BY dt""")
def golden_daily_check(spark, sf_dir):
    """The same day by day, both sides read from stored runs."""
    out = fresh_dir(spark, "run")
    changed = F.when(F.expr("key = 'click' AND day(dt) <= 3"), F.col("total") + 1).otherwise(F.col("total")).cast("decimal(38,2)")
    package.run_package(spark, sf_dir, out, "golden", [("daily_panel", lambda s, d: Q.daily_panel(s, d).withColumn("total", changed))])
    package.run_package(spark, sf_dir, out, "today", STEPS[:1])
    return package.check_days(spark, out, "today", "golden", "daily_panel", ["key", "dt"], "dt")


@register("write_once", f"""SELECT a.attempt, a.attempt < 3 AS accepted, count(*) AS n_rows FROM ({Q._PANEL}) p, (SELECT unnest([1, 2, 3]) AS attempt) a
  WHERE a.attempt <> 2 OR key = 'view' GROUP BY a.attempt""")
def write_once(spark, sf_dir):
    """Two runs are accepted; the third takes the first one's id, is refused, and
    leaves the first one's rows as they were."""
    out, panel, said = fresh_dir(spark, "run"), Q.daily_panel(spark, sf_dir), []
    for attempt, (run_id, df) in enumerate((("a", panel), ("b", panel.filter("key = 'view'")), ("a", panel.limit(1))), 1):
        try:
            write_result(df, out, run_id, "daily_panel")
            accepted = True
        except AnalysisException:
            accepted = False
        n = read_result(spark, out, run_id, "daily_panel").agg(F.count("*").alias("n_rows"))
        said.append(n.select(F.lit(attempt).alias("attempt"), F.lit(accepted).alias("accepted"), "n_rows"))
    return said[0].union(said[1]).union(said[2])


def _through(fmt):
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", F.to_date("ts").alias("dt"))
        odd = e.withColumn("props", F.expr("CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a,\"b\" <c> & é' ELSE props END"))
        return formats.read_format(spark, formats.write_format(odd, fresh_dir(spark, fmt), fmt), fmt, odd.schema)

    run.__doc__ = f"Events with odd characters and nulls, written and read as {fmt}."
    return run


for _fmt in ("csv", "json", "orc", "xml"):
    register(f"source_{_fmt}", """SELECT event_id, user_id, event_type, value, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a,"b" <c> & é' ELSE props END AS props, CAST(ts AS DATE) AS dt FROM events""")(_through(_fmt))


@register("source_text", "SELECT p_name AS value FROM part")
def source_text(spark, sf_dir):
    return formats.read_lines(spark, formats.write_lines(table(spark, sf_dir, "part").select("p_name"), fresh_dir(spark, "text")))


@register("source_jdbc", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 500")
def source_jdbc(spark, sf_dir):
    """Through an embedded database, read back by the executors in four ranges."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    url = embedded.write_embedded(customers, "customer")
    low, high = customers.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return formats.read_jdbc(spark, url, "customer", embedded.DRIVER, "c_custkey", low or 0, high or 0, 4).filter("c_acctbal > 500")


_STATISTICS = f"SELECT key, state, count(*) AS n_days FROM ({Q._STATE}) GROUP BY key, state"


@register("report_markdown", f"""SELECT CAST(0 AS BIGINT) AS line_no, '| key | state | n_days |' AS line UNION ALL SELECT 1, '|-|-|-|'
  UNION ALL SELECT row_number() OVER (ORDER BY key, state NULLS FIRST) + 1, '| ' || key || ' | ' || coalesce(CAST(state AS VARCHAR), '') || ' | ' || n_days || ' |' FROM ({_STATISTICS})""")
def report_markdown(spark, sf_dir):
    n = Q.three_state(spark, sf_dir).groupBy("key", "state").agg(F.count("*").alias("n_days"))
    return reports.markdown_lines(n, ["key", "state"])


@register("report_html", f"""SELECT row_number() OVER (ORDER BY key, state NULLS FIRST) AS line_no,
  '<tr><td>' || key || '</td><td>' || coalesce(CAST(state AS VARCHAR), '') || '</td><td>' || n_days || '</td></tr>' AS line FROM ({_STATISTICS})""")
def report_html(spark, sf_dir):
    """The rows of the page, without its head and foot."""
    n = Q.three_state(spark, sf_dir).groupBy("key", "state").agg(F.count("*").alias("n_days"))
    return reports.html_lines(n, ["key", "state"], "States").filter("line LIKE '<tr>%'")
