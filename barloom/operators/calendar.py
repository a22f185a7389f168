"""Contract calendars, refresh plans and trading sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.columns import contract_period, months_diff


def _day(today: str | Column) -> Column:
    return F.lit(today).cast("date") if isinstance(today, str) else today


def contract_symbols(registry: DataFrame, start_year: int | Column, end_year: int | Column) -> DataFrame:
    """Every CODE + YY + MM of the registry's products (column code): product, contract, period."""
    start, end = (y if isinstance(y, Column) else F.lit(y) for y in (start_year, end_year))
    years = F.explode(F.sequence(start, end)).alias("year")
    rows = registry.select(F.col("code").alias("product"), years)
    rows = rows.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    name = F.format_string("%s%02d%02d", "product", F.col("year") % 100, "month")
    rows = rows.withColumn("contract", name)
    return rows.select("product", "contract", contract_period("contract", "product").alias("period"))


def in_listing_window(df: DataFrame, today: str | Column, months: int = 15) -> DataFrame:
    """Contracts (with period) that deliver at most so many months ahead."""
    return df.filter(months_diff(F.col("period"), _day(today)) <= months)


def with_settled(df: DataFrame, today: str | Column, months: int = 2) -> DataFrame:
    """settled: delivery lies more than so many months back."""
    return df.withColumn("settled", months_diff(_day(today), F.col("period")) > months)


def refresh_plan(symbols: DataFrame, manifest: DataFrame, today: str | Column, force: bool = False) -> DataFrame:
    """Which contracts to fetch: all but the settled ones whose cached file has rows.

    symbols has contract and period, manifest contract and rows. Adds settled,
    cached (a file is known) and refetch.
    """
    known = manifest.select("contract", F.col("rows").alias("_rows"))
    out = with_settled(symbols.join(known, "contract", "left"), today).withColumn("cached", F.col("_rows").isNotNull())
    kept = F.col("settled") & F.col("cached") & (F.coalesce("_rows", F.lit(0)) > 0)
    return out.withColumn("refetch", F.lit(True) if force else ~kept).drop("_rows")


def previous_session(dates: DataFrame, calendar: DataFrame, date: str = "date", session: str = "trade_date") -> DataFrame:
    """For each distinct date: is_trading_day, and the last session strictly before it.

    An as-of join without a join: dates and sessions are dealt by year into one
    sorted run each, and a year's dates that precede its first session take the
    last session of the years before. Repeated and NULL dates count once and not
    at all. A date before the whole calendar is an error when the row is read.
    """
    days = calendar.select(F.col(session).cast("date").alias("_d")).dropna().distinct().withColumn("_s", F.col("_d"))
    asked = dates.select(F.col(date).cast("date").alias("_d")).dropna().distinct().withColumn("_q", F.lit(True))
    rows = asked.join(days, "_d", "full").withColumn("_y", F.year("_d"))
    ends = days.groupBy(F.year("_d").alias("_y")).agg(F.max("_s").alias("_end"))
    # one row per year
    years = rows.select("_y").distinct().join(ends, "_y", "left")
    before = F.last("_end", ignorenulls=True).over(W.partitionBy(F.lit(0)).orderBy("_y").rowsBetween(W.unboundedPreceding, -1))
    years = years.select("_y", before.alias("_before"))
    inside = F.last("_s", ignorenulls=True).over(W.partitionBy("_y").orderBy("_d").rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumn("_inside", inside).filter("_q").join(years, "_y")
    found = F.coalesce("_inside", "_before")
    checked = F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no session before "), F.col("_d").cast("string"))).cast("date"))
    return out.select(F.col("_d").alias(date), F.col("_s").isNotNull().alias("is_trading_day"), checked.alias("previous_session"))
