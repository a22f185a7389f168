"""Purged, expanding walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.guards import some_rows

NO_FOLDS = "not enough rows for a walk-forward fold"


def assign_folds(df: DataFrame, key: Sequence[str], horizon: int | str, start_date: str | None = "2021-05-11", ratio: float = 0.6, min_train: int = 252, test_rows: int = 63, purge: int | None = None) -> DataFrame:
    """Adds position, start, fold and train_end to model rows.

    Tests begin at the first row of start_date or later if that is at least at
    position min_train, else after the larger of ratio and min_train. Fold k tests
    test_rows rows and trains on the rows before its start less the purge (the
    horizon unless given; 0 leaves none out). Rows before the tests, and tests
    with fewer than min_train training rows, have no fold. horizon may be the name of
    a column that is constant within a key.
    """
    by_key = W.partitionBy(*key)
    out = df.withColumn("position", F.row_number().over(by_key.orderBy("date")) - 1)
    first = F.min(F.when(F.col("date") >= F.lit(start_date).cast("date"), F.col("position"))).over(by_key)
    late = F.greatest(F.floor(F.lit(ratio) * F.count("*").over(by_key)), F.lit(min_train))
    out = out.withColumn("start", F.when(first >= min_train, first).otherwise(late).cast("int"))
    out = out.withColumn("fold", F.floor((F.col("position") - F.col("start")) / test_rows).cast("int"))
    gap = (F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)) if purge is None else F.lit(purge)
    end = F.greatest(F.col("start") + F.col("fold") * test_rows - gap, F.lit(0))
    tested = (F.col("fold") >= 0) & (end >= min_train)
    return out.withColumns({"train_end": F.when(tested, end), "fold": F.when(tested, F.col("fold"))})


def fold_table(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key and fold: train_end and its last training date, the tested dates and their number."""
    tests = df.filter("fold IS NOT NULL").groupBy(*key, "fold").agg(
        F.first("train_end").alias("train_end"), F.min("date").alias("test_window_start"), F.max("date").alias("test_window_end"), F.count("*").alias("test_rows")
    )
    last = df.select(*key, (F.col("position") + 1).alias("train_end"), F.col("date").alias("train_end_date"))
    return tests.join(last, [*key, "train_end"], "left")


def with_fold_dates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The tested rows of df with their fold's train_end_date, test_window_start and test_window_end."""
    folds = fold_table(df, key).select(*key, "fold", "train_end_date", "test_window_start", "test_window_end")
    return df.filter("fold IS NOT NULL").join(folds, [*key, "fold"])


def tested(df: DataFrame) -> DataFrame:
    """The rows of df that have a fold; reading them fails if none has one."""
    rows = df.filter("fold IS NOT NULL")
    return some_rows(rows, rows.select("fold"), NO_FOLDS)


def require_folds(df: DataFrame) -> DataFrame:
    """df, if any row has a fold; else ValueError, at once (tested() fails when it is read)."""
    if df.filter("fold IS NOT NULL").isEmpty():
        raise ValueError(NO_FOLDS)
    return df
