"""Backtests of the sign of a prediction, their metrics, and the quality of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.operators import longseries as N

KEY = ("dataset", "horizon")


def backtest(pred: DataFrame, key: Sequence[str] = KEY, cost_bps: float = 2.0, block_rows: int | None = None) -> DataFrame:
    """Adds signal, position, turnover, daily returns and equities to predictions (date, daily_return_pct, prediction).

    The position is the previous row's signal and runs across fold borders; a
    change costs cost_bps per unit, so a flip from -1 to 1 costs twice that. With
    block_rows no task holds more of a series than a block, or a span of days.
    """
    out = pred.withColumn("signal", F.when(F.col("prediction") > 0, 1).otherwise(-1))
    if block_rows:
        out = N.haloed(out, key, before=2, rows=block_rows)
    w = W.partitionBy(*key, *(["_block"] if block_rows else [])).orderBy("date")
    out = out.withColumn("position", F.coalesce(F.lag("signal").over(w), F.lit(0)))
    out = out.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))
    strategy = F.col("position") * F.col("daily_return_pct") - F.col("turnover") * F.lit(cost_bps / 100)
    out = out.withColumns({"strategy_daily_return_pct": strategy, "buy_hold_daily_return_pct": F.col("daily_return_pct")})
    if block_rows:
        sums = {f"_{kind}": ("sum", F.col(f"{kind}_daily_return_pct")) for kind in ("strategy", "buy_hold")}
        out = N.scanned(N.inside(out), key, sums)
        return out.withColumns({f"{kind}_equity": F.exp(F.col(f"_{kind}") / 100) for kind in ("strategy", "buy_hold")}).drop("_strategy", "_buy_hold")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    equity = lambda kind: F.exp(F.sum(f"{kind}_daily_return_pct").over(upto) / 100)
    return out.withColumns({"strategy_equity": equity("strategy"), "buy_hold_equity": equity("buy_hold")})


def error_metrics() -> list[Column]:
    """Aggregates over target and prediction: mae, rmse, r2 and directional_accuracy (zero matches zero only)."""
    error = F.col("target") - F.col("prediction")
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop("target") * F.count("target"))).alias("r2"),
        F.avg((F.signum("target") == F.signum("prediction")).cast("double")).alias("directional_accuracy"),
    ]


def metrics(bt: DataFrame, key: Sequence[str] = KEY, model_rows: DataFrame | None = None, long: bool = False) -> DataFrame:
    """One row per key: size and dates of the backtest, errors, returns, risk and trades.

    model_rows, where given, adds trainable_rows, model_start_date and model_end_date.
    long: the highest equity so far is carried from span to span of a series.
    """
    if long:
        rows = N.scanned(bt, key, {"_peak": ("max", F.col("strategy_equity"))})
    else:
        rows = bt.withColumn("_peak", F.max("strategy_equity").over(W.partitionBy(*key).orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_fall", F.try_divide(F.col("strategy_equity"), F.col("_peak")) - 1)
    yearly = F.avg("strategy_daily_return_pct") * 252
    risk = F.stddev_pop("strategy_daily_return_pct") * F.sqrt(F.lit(252.0))
    out = rows.groupBy(*key).agg(
        F.count("*").alias("rows"),
        F.min("date").alias("backtest_start_date"),
        F.max("date").alias("backtest_end_date"),
        *error_metrics(),
        ((F.max_by("strategy_equity", "date") - 1) * 100).alias("strategy_total_return_pct"),
        ((F.max_by("buy_hold_equity", "date") - 1) * 100).alias("buy_hold_total_return_pct"),
        yearly.alias("strategy_annual_return_pct"),
        risk.alias("strategy_annual_vol_pct"),
        F.try_divide(yearly, risk).alias("strategy_sharpe"),
        (F.min("_fall") * 100).alias("max_drawdown_pct"),
        F.count_if(F.col("turnover") > 0).alias("trade_count"),
    )
    if model_rows is None:
        return out
    known = model_rows.groupBy(*key).agg(F.count("*").alias("trainable_rows"), F.min("date").alias("model_start_date"), F.max("date").alias("model_end_date"))
    return out.join(known, list(key))


def forecast_quality(pred: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per key and direction of the forecast: how many, how strong, and how often right.

    A bullish forecast (above 0) is right if the realised return is above 0, a
    bearish one if it is below; a realised 0 is wrong. A direction without
    forecasts has no row. The median is exact, without holding a group's values.
    """
    bullish = F.col("prediction") > 0
    right = F.when(bullish, F.col("target") > 0).otherwise(F.col("target") < 0)
    rows = pred.withColumns({"forecast": F.when(bullish, "bullish").otherwise("bearish"), "_right": F.coalesce(right, F.lit(False))})
    out = rows.groupBy(*key, "forecast").agg(
        F.count("*").alias("samples"),
        F.avg("prediction").alias("avg_predicted_return_pct"),
        F.avg("target").alias("avg_realized_return_pct"),
        F.avg(F.col("_right").cast("double")).alias("direction_accuracy"),
    )
    out = N.joined(out, N.median(rows, [*key, "forecast"], "target", "median_realized_return_pct"), [*key, "forecast"], "left")
    return out.withColumn("sample_share", F.col("samples") / F.sum("samples").over(W.partitionBy(*key)))


def latest_vs_verified(latest: DataFrame, bt: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Per key: the live signal beside the last backtested forecast and what came of it."""
    last = bt.groupBy(*key).agg(F.max_by(F.struct("date", "prediction", "target", "signal"), "date").alias("_v"))
    last = last.select(*key, *[F.col(f"_v.{c}").alias(f"verified_{c}") for c in ("date", "prediction", "target", "signal")])
    live = latest.select(*key, *[F.col(c).alias(f"live_{c}") for c in ("date", "close", "prediction", "signal")])
    return live.join(last, list(key), "left")
