"""Projection, filtering and cleaning of bars."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions import columns as C
from barloom.sources.schemas import validate_columns

REQUIRED = ("date", "open", "high", "low", "close", "volume", "settle")
#: Columns of a weighted series that are numbers where present.
WEIGHTED = (
    "active_contracts",
    "dominant_volume_share",
    "second_volume_share",
    "dominant_oi_share",
    "second_oi_share",
    "volume_roll_pressure",
    "oi_roll_pressure",
    "dominant_contract_changed",
    "dominant_volume_contract_changed",
)


def dated(df: DataFrame, numbers: Sequence[str], on_bad: str = "raise", rejects: Observation | None = None) -> DataFrame:
    """df with date as a date and numbers as doubles, both from text or what they are already; rows without a date are dropped.

    A date that does not parse stops the job when it is read (raise) or is dropped
    as well (drop); a number that does not parse, NaN and infinities become NULL.
    rejects, where given, counts them in the same pass: bad_dates and bad_<number>.
    """
    if on_bad not in ("raise", "drop"):
        raise ValueError(f"on_bad is raise or drop, not {on_bad}")
    day = F.expr("try_cast(date AS date)")
    bad_date = F.col("date").isNotNull() & day.isNull()
    if rejects is not None:
        bad = [F.count_if(F.col(c).isNotNull() & C.clean(c).isNull()).alias(f"bad_{c}") for c in numbers]
        df = df.observe(rejects, F.count_if(bad_date).alias("bad_dates"), *bad)
    if on_bad == "raise":
        day = F.when(bad_date, F.raise_error(F.concat(F.lit("not a date: "), F.col("date").cast("string"))).cast("date")).otherwise(day)
    out = df.withColumns({"date": day, **{c: C.clean(c) for c in numbers}})
    return out.filter("date IS NOT NULL")


def normalize_market(df: DataFrame, dataset: str | None, ordinal: str, key: Sequence[str] = (), on_bad: str = "raise", rejects: Observation | None = None) -> DataFrame:
    """A market series in its normal form: open_interest for hold, true dates, numbers or NULL, one row per date.

    Of several rows of a date that with the largest ordinal stays (ordinal is any
    orderable column; it is dropped). dataset=None keeps df's own dataset column.
    Bad values go as dated says; a row without a date never enters a window.
    """
    if "open_interest" not in df.columns and "hold" in df.columns:
        df = df.withColumnRenamed("hold", "open_interest")
    validate_columns(df, [*REQUIRED, "open_interest"])
    numbers = [*REQUIRED[1:], "open_interest", *(c for c in df.columns if c in WEIGHTED or c == "oi_weighted_close")]
    out = dated(df, numbers, on_bad, rejects)
    if dataset is not None:
        out = out.withColumn("dataset", F.lit(dataset))
    last = F.row_number().over(W.partitionBy("dataset", *key, "date").orderBy(F.col(ordinal).desc()))
    return out.withColumn("_last", last).filter("_last = 1").drop("_last", ordinal)


def only_symbols(df: DataFrame, symbols: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    return df.filter(F.col("symbol").isin(*symbols)).select(*(columns or df.columns))


def date_range(df: DataFrame, start: datetime.date | str | None = None, end: datetime.date | str | None = None, time: str = "date") -> DataFrame:
    """Rows from start to end, both included, each optional."""
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col(time) <= F.lit(end).cast("date"))


def zero_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: C.zero_to_null(c) for c in cols})


def inf_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinities and NaN from outside become NULL."""
    return df.withColumns({c: C.clean(c) for c in cols})


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))
