"""Fixed table layouts: a result has the declared columns or it is refused.

The source material gives only the numbers of columns (eight and nine); the
names and types here are this project's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {"key": T.StringType(), "dt": T.DateType(), "execution_dt": T.DateType(), "total": T.DecimalType(38, 2), "ret": T.DoubleType(), "seg": T.LongType()}


def _layout(names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES.get(n, T.IntegerType())) for n in names.split()])


COMPACT = _layout("key dt execution_dt total ret state position age")
BASELINE = _layout("key dt total ret state prev_state seg reversal exit_from")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in their order. Raises ValueError, naming each missing
    column and each of another type; further columns are left out."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: missing" for f in schema if f.name not in have]
    wrong += [f"{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema if f.name in have and have[f.name] != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*schema.names)
