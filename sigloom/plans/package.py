"""Ordered runs of table-producing steps, and their check against a stored run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.operators.tables import daily_parity, parity_report
from sigloom.sources.tables import read_result, write_result

Step = tuple[str, Callable[[SparkSession, str], DataFrame]]


def run_package(spark: SparkSession, sf_dir: str, out_dir: str, run_id: str, steps: list[Step]) -> dict[str, str]:
    """Writes each step's table in order; a run id is used once. All steps read
    the one sf_dir: there is no way to hand in an older panel."""
    return {name: write_result(step(spark, sf_dir), out_dir, run_id, name) for name, step in steps}


def check_package(spark: SparkSession, out_dir: str, run_id: str, golden_id: str, keys: dict[str, list[str]], tolerance: float = 0.0) -> DataFrame:
    """(table, differences, verdict) of a run's tables against a stored run's."""
    pairs = {name: (read_result(spark, out_dir, run_id, name), read_result(spark, out_dir, golden_id, name), k) for name, k in keys.items()}
    return parity_report(pairs, tolerance)


def run_and_check(spark: SparkSession, sf_dir: str, out_dir: str, run_id: str, golden_id: str, steps: list[Step], keys: dict[str, list[str]], tolerance: float = 0.0) -> DataFrame:
    """The steps in order, and only then the check of what they wrote."""
    run_package(spark, sf_dir, out_dir, run_id, steps)
    return check_package(spark, out_dir, run_id, golden_id, keys, tolerance)


def check_days(spark: SparkSession, out_dir: str, run_id: str, golden_id: str, name: str, keys: list[str], day: str) -> DataFrame:
    """(day, differences) of one table of two stored runs."""
    return daily_parity(read_result(spark, out_dir, run_id, name), read_result(spark, out_dir, golden_id, name), keys, day)
