"""Structured Streaming over the events table. A stream reads the files of a
directory or one table; event time is a zoned timestamp, as watermarks need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sigloom.sources.scratch import fresh_dir


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*events*").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def files_stream(spark: SparkSession, path: str) -> DataFrame:
    """A directory of event files, one a batch, oldest first."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def hourly_counts(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def user_sessions(events: DataFrame, gap: str = "6 hours", lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def _running(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for f in frames:
        n, total = n + len(f), total + float(f["value"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame) -> DataFrame:
    """Custom state: each user's count and sum after every batch that has it."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.select("user_id", "value").groupBy("user_id").applyInPandasWithState(_running, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


class _Totals(StatefulProcessor):
    """Count and sum of a user, in one value of the state store."""

    def init(self, handle) -> None:
        self._state = handle.getValueState("totals", "n long, total double")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        n, total = self._state.get() if self._state.exists() else (0, 0.0)
        for f in rows:
            n, total = n + len(f), total + float(f["value"].sum())
        self._state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def keyed_totals(events: DataFrame) -> DataFrame:
    """running_totals with the newer state API; needs the RocksDB state store."""
    return events.select("user_id", "value").groupBy("user_id").transformWithStateInPandas(_Totals(), "user_id long, n long, total double", "Update", "None")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_to_end(stream: DataFrame, mode: str, conf: dict[str, str] | None = None) -> DataFrame:
    """All that is there now, through files in the shared folder with a checkpoint:
    the rows of every batch, or of the last one in complete mode. Nothing passes
    the driver. conf: settings to start the query under."""
    spark, root = stream.sparkSession, fresh_dir(stream.sparkSession, "stream")
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batches/{number}")
        done.append(number)

    old = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not done:
        return spark.createDataFrame([], stream.schema)
    wanted = [max(done)] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*(f"{root}/batches/{n}" for n in wanted))


def append_to_table(stream: DataFrame, path: str, checkpoint: str):
    """A Parquet sink with its own checkpoint: exactly once over restarts."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clicks_after_errors(events: DataFrame, lateness: str = "1 hour", within: str = "30 minutes") -> DataFrame:
    """Stream-stream join on user and time; watermarks on both sides bound the state."""
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), "user_id", F.col("ts").alias("error_ts")).withWatermark("error_ts", lateness)
    clicks = events.filter("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("by_user"), "ts").withWatermark("ts", lateness)
    near = (F.col("user_id") == F.col("by_user")) & (F.col("ts") >= F.col("error_ts")) & (F.col("ts") <= F.col("error_ts") + F.expr(f"INTERVAL {within}"))
    return errors.join(clicks, near).select("error_id", "click_id")
