"""Streams, run to their end, against batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigloom.plans.catalog import register
from sigloom.sources.scratch import fresh_dir
from sigloom.sources.tables import table
from sigloom.streaming import streams as S


@register("stream_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark, sf_dir):
    return S.run_to_end(S.hourly_counts(S.event_stream(spark, sf_dir)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start")
def stream_sliding(spark, sf_dir):
    return S.run_to_end(S.sliding_counts(S.event_stream(spark, sf_dir)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


#: In append mode a window or session comes out once the watermark, an hour behind
#: the latest row, has passed its end.
_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@register("stream_hourly_append", f"""SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  WHERE start + INTERVAL 1 HOUR <= {_MARK}""")
def stream_hourly_append(spark, sf_dir):
    return S.run_to_end(S.hourly_counts(S.event_stream(spark, sf_dir)), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_sliding_append", f"""SELECT * FROM (SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY start)
  WHERE start + INTERVAL 2 HOUR <= {_MARK}""")
def stream_sliding_append(spark, sf_dir):
    return S.run_to_end(S.sliding_counts(S.event_stream(spark, sf_dir)), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_dedup", "SELECT event_id FROM events")
def stream_dedup(spark, sf_dir):
    """Every third event comes twice."""
    e, path = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), fresh_dir(spark, "events")
    e.union(e.filter("event_id % 3 = 0")).coalesce(1).write.parquet(path)
    return S.run_to_end(S.deduplicated(S.files_stream(spark, path)).select("event_id"), "append")


@register("stream_late", f"""WITH f AS (SELECT *, event_type = 'click' AND event_id % 5 = 0 AND ts < TIMESTAMP '2024-01-20' AS held FROM events),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM f WHERE ts < TIMESTAMP '2024-01-10' AND NOT held),
k AS (SELECT f.* FROM f, m WHERE NOT (held AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark))
SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM k GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= {_MARK}""")
def stream_late(spark, sf_dir):
    """Three files: the last also holds clicks that should have come before. A batch
    drops rows whose hour was closed by the watermark that the batch before it
    began with, which is the first file's."""
    e, path = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), fresh_dir(spark, "events")
    before = lambda day: F.col("ts") < F.lit(day).cast("timestamp")
    held = (F.col("event_type") == "click") & (F.col("event_id") % 5 == 0) & before("2024-01-20")
    part = F.when(held | ~before("2024-01-20"), 2).when(before("2024-01-10"), 0).otherwise(1)
    for k in range(3):
        e.filter(part == k).coalesce(1).write.mode("append").parquet(path)
    return S.run_to_end(S.hourly_counts(S.files_stream(spark, path)), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


_TOTALS = "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id"


@register("stream_totals", _TOTALS)
def stream_totals(spark, sf_dir):
    return S.run_to_end(S.running_totals(S.event_stream(spark, sf_dir)), "update").withColumn("total", F.round("total", 4))


@register("stream_keyed_totals", _TOTALS)
def stream_keyed_totals(spark, sf_dir):
    return S.run_to_end(S.keyed_totals(S.event_stream(spark, sf_dir)), "update", S.ROCKS).withColumn("total", F.round("total", 4))


@register("stream_sessions", f"""SELECT user_id, start, n FROM (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events))
  GROUP BY user_id, s) WHERE last + INTERVAL 6 HOUR <= {_MARK}""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed: those of a batch without the open ones."""
    return S.run_to_end(S.user_sessions(S.event_stream(spark, sf_dir)), "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("stream_join", """SELECT a.event_id AS error_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id
  AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 30 MINUTE WHERE a.event_type = 'error' AND b.event_type = 'click'""")
def stream_join(spark, sf_dir):
    return S.run_to_end(S.clicks_after_errors(S.event_stream(spark, sf_dir)), "append")
