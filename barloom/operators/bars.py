"""The canned questions to a bar table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.operators.clean import date_range


def summary(df: DataFrame, key: Sequence[str] = ("symbol", "commodity_slug")) -> DataFrame:
    out = df.groupBy(*key).agg(
        F.count("*").alias("rows"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.round(F.min("close"), 2).alias("min_close"),
        F.round(F.max("close"), 2).alias("max_close"),
    )
    return out.orderBy(*key)


def latest(df: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last row of each key."""
    at = F.row_number().over(W.partitionBy(*key).orderBy(F.col("date").desc()))
    return df.withColumn("_at", at).filter("_at = 1").drop("_at").orderBy(*key)


def interval_returns(df: DataFrame, key: Sequence[str] = ("symbol", "commodity_slug"), start: str | None = None, end: str | None = None) -> DataFrame:
    """First and last close of each key between two dates and the change in percent, in one aggregation."""
    out = date_range(df, start, end).groupBy(*key).agg(
        F.min("date").alias("start_date"),
        F.min_by("close", "date").alias("start_close"),
        F.max("date").alias("end_date"),
        F.max_by("close", "date").alias("end_close"),
    )
    change = F.round((F.try_divide(F.col("end_close"), F.col("start_close")) - 1) * 100, 2)
    return out.withColumn("return_pct", change).orderBy(*key)
