"""The subpackage's queries and their SQL, in one place for the entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import decontaminate, fm_dedup, licenses, mixing, pii, quality_model, quality_rules, simhash, suffix_dedup, toxicity

_MODULES = [toxicity, fm_dedup, licenses, quality_model, suffix_dedup, quality_rules, simhash, pii, mixing, decontaminate]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in getattr(m, "ORACLES", {}).items()}
