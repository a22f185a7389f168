"""Publication of the latest signals as one nested document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.guards import guarded
from barloom.operators.calendar import previous_session


def latest_signals(latest: DataFrame, quality: DataFrame) -> DataFrame:
    """product, horizon, date, close and the forecast struct; quality is that of the same direction, or NULL."""
    live = latest.withColumn("direction", F.when(F.col("signal") > 0, "bullish").otherwise("bearish"))
    known = quality.select("product", "horizon", F.col("forecast").alias("direction"), F.struct("samples", F.col("avg_realized_return_pct"), "direction_accuracy").alias("quality"))
    joined = live.join(known, ["product", "horizon", "direction"], "left")
    forecast = F.struct(F.col("prediction").alias("predicted_return_pct"), "signal", "direction", "quality")
    return joined.select("product", "horizon", "date", "close", forecast.alias("forecast"))


def assert_one_source_date(df: DataFrame) -> DataFrame:
    """df, if all horizons of each product share one date; else ValueError with the dates of one that don't."""
    wrong = df.groupBy("product").agg(F.array_sort(F.collect_set("date")).alias("dates")).filter(F.size("dates") > 1)
    if bad := wrong.orderBy("product").first():
        raise ValueError(f"{bad['product']} has inconsistent source dates: {[d.isoformat() for d in bad['dates']]}")
    return df


def one_source_date(df: DataFrame) -> DataFrame:
    """df; reading it fails, with the dates, where the horizons of a product have several."""
    dates = df.groupBy("product").agg(F.array_sort(F.collect_set(F.col("date").cast("string"))).alias("_dates"))
    return guarded(df, dates, F.size("_dates") > 1, F.concat("product", F.lit(" has inconsistent source dates: "), F.array_join("_dates", ", ")))


def payload(df: DataFrame, calendar: DataFrame, report_date: str, generated_at: str, names: DataFrame | None = None) -> DataFrame:
    """One row, column value: the JSON document of all products (df is from latest_signals).

    calendar has trade_date; names (product, name) is optional.
    """
    spark = df.sparkSession
    if names is not None:
        df = df.join(names.select("product", F.col("name")), "product", "left")
    else:
        df = df.withColumn("name", F.lit(None).cast("string"))
    forecasts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("string").alias("horizon"), "forecast"))))
    products = df.groupBy("product").agg(F.first("name").alias("name"), F.max("date").alias("source_date"), F.max_by("close", "horizon").alias("close"), forecasts.alias("forecasts"))
    each = F.struct("name", F.date_format("source_date", "yyyy-MM-dd").alias("source_date"), "close", "forecasts")
    by_product = lambda a, b: F.when(a["product"] < b["product"], -1).otherwise(1)
    document = products.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("product", each.alias("of"))), by_product)).alias("products"))
    day = previous_session(spark.createDataFrame([(report_date,)], "date string"), calendar)
    day = day.select(F.date_format("date", "yyyy-MM-dd").alias("report_date"), "is_trading_day", F.date_format("previous_session", "yyyy-MM-dd").alias("expected_source_date"))
    # both sides are one row
    joined = document.withColumn("_one", F.lit(1)).join(day.withColumn("_one", F.lit(1)), "_one")
    head = [F.lit(1).alias("schema_version"), F.lit(generated_at).alias("generated_at")]
    return joined.select(F.to_json(F.struct(*head, "report_date", "is_trading_day", "expected_source_date", "products"), {"ignoreNullFields": "false"}).alias("value"))
