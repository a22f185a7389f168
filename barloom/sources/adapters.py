"""Bars made from the order and event tables, so that every panel operator has market-shaped input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lineitem: DataFrame, keys: list[Column], hold: Column) -> DataFrame:
    """Open and close are the first and last price in the order of the lines; sums are rounded to their inputs' decimals."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return lineitem.groupBy(*keys, F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        (F.round(F.sum("l_extendedprice"), 2) / F.sum("l_quantity")).alias("settle"),
        F.sum("l_quantity").alias("volume"),
        hold.alias("hold"),
    )


def contract_bars(lineitem: DataFrame) -> DataFrame:
    """product, contract, date and measures; hold is the open quantity, which is often 0."""
    keys = [F.col("l_returnflag").alias("product"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("contract")]
    return _bars(lineitem, keys, F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)))


def main_bars(lineitem: DataFrame) -> DataFrame:
    """symbol, date and measures; hold is the discounted value, which is always positive."""
    hold = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4)
    return _bars(lineitem, [F.col("l_returnflag").alias("symbol")], hold)


def hourly_bars(events: DataFrame) -> DataFrame:
    """symbol, date (the hour), open, high, low, close and volume (number of events)."""
    order = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("date")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
