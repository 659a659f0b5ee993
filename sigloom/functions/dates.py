"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column, formats: tuple[str, ...]) -> Column:
    """The first format that fits; null if none does. Never raises."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats))
