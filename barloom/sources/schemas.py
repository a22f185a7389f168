"""Schemas of bar files and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MEASURES = ("open", "high", "low", "close", "volume", "hold", "settle")
#: Files are read as text and coerced after, so that a bad number is NULL and not an error.
BAR_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("date", *MEASURES)])
CONTRACT_FILE = T.StructType([T.StructField("contract", T.StringType()), *BAR_FILE.fields])
BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("commodity_slug", T.StringType()),
        T.StructField("date", T.DateType()),
        *(T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close")),
        T.StructField("volume", T.LongType()),
        T.StructField("hold", T.LongType()),
        T.StructField("settle", T.DoubleType()),
    ]
)


def validate_columns(df: DataFrame, required: Sequence[str], exact: bool = False) -> DataFrame:
    """df, if it has the required columns (exact: these and no others, in this order); else ValueError."""
    if exact and df.columns != list(required):
        raise ValueError(f"columns are {df.columns}, not {list(required)}")
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df
