"""Late data, and a file sink over restarts."""

import datetime

from pyspark.sql import functions as F

from sigloom.streaming import streams as S

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, event_type string"


def write(spark, path, rows):
    spark.createDataFrame([(i, T0 + datetime.timedelta(minutes=m), "a") for i, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_rows_are_dropped_and_restarts_continue(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    counts = lambda: S.append_to_table(S.hourly_counts(read(spark, src)), out, ck).awaitTermination()
    write(spark, src, [(1, 5), (2, 10), (3, 200)])
    counts()
    write(spark, src, [(4, 7), (5, 500)])  # 4 is three hours late by now
    counts()
    got = {r["start"]: r["n"] for r in spark.read.parquet(out).withColumn("start", F.col("start").cast("string")).collect()}
    assert got["2024-01-01 00:00:00"] == 2
    assert "2024-01-01 08:00:00" not in got  # still open
    counts()  # nothing new: nothing is written twice
    assert spark.read.parquet(out).count() == len(got)


def test_duplicates_within_the_watermark(spark, tmp_path):
    src = f"{tmp_path}/in"
    write(spark, src, [(1, 1), (1, 2), (2, 3)])
    assert sorted(r.event_id for r in S.run_to_end(S.deduplicated(read(spark, src)), "append").collect()) == [1, 2]
