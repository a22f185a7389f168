"""Checks that run inside the plan: an error is raised when the sink is written, without a job of its own before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(df: DataFrame, check: DataFrame, bad: Column, message: Column | str) -> DataFrame:
    """df; reading it fails with the message where a row of check is bad.

    The check is a branch without rows that is put under df: its only way out is the
    error, and as a filter's condition it is evaluated whatever columns are read of df.
    """
    text = F.lit(message) if isinstance(message, str) else message
    # raise_error gives no value, so the branch ends empty wherever it does not fail
    none = check.filter(F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(False)))
    return df.unionByName(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def some_rows(df: DataFrame, of: DataFrame, message: str) -> DataFrame:
    """df, if ``of`` has any row."""
    return guarded(df, of.agg(F.count("*").alias("_n")), F.col("_n") == 0, message)


def unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df, if no key occurs twice."""
    at = F.concat_ws(", ", *[F.col(k).cast("string") for k in key])
    return guarded(df, df.groupBy(*key).agg(F.count("*").alias("_n")), F.col("_n") > 1, F.concat(F.lit(f"repeated rows of one {tuple(key)}: "), at))
