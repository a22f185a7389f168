"""Delivery-month contracts collapsed into a weighted continuous index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.columns import log_ratio_pct, weighted_average
from barloom.operators import longseries as N

PRICES = ("open", "high", "low", "close", "settle")
#: Weights: the column and what its results are called.
WEIGHTS = {"volume": "volume", "hold": "oi"}


def contract_returns(df: DataFrame, key: str = "product") -> DataFrame:
    """Adds the previous row's close, volume and hold of each contract, and its log return in percent."""
    w = W.partitionBy(key, "contract").orderBy("date")
    out = df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in ("close", "volume", "hold")})
    return out.withColumn("contract_return_pct", log_ratio_pct("close", "prev_close"))


def _total_aggregates() -> list[Column]:
    live = F.coalesce(F.col("volume") > 0, F.lit(False)) | F.coalesce(F.col("hold") > 0, F.lit(False))
    aggs = [
        F.count_if(live).alias("active_contracts"),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        F.coalesce(F.sum("hold"), F.lit(0.0)).alias("open_interest"),
    ]
    for weight, name in WEIGHTS.items():
        aggs.append(weighted_average("contract_return_pct", f"prev_{weight}").alias(f"{name}_weighted_return_pct"))
        aggs += [weighted_average(p, weight).alias(f"{name}_weighted_{p}") for p in PRICES]
    return aggs


def daily_totals(df: DataFrame, key: str = "product") -> DataFrame:
    """Per day: contracts with volume or hold, totals, weighted returns (by the previous row's weights) and prices."""
    return df.groupBy(key, "date").agg(*_total_aggregates())


def _ranked(df: DataFrame, weight: str, key: str) -> Column:
    """Rank by weight within the day, ties by contract; rows without a positive weight have none."""
    order = W.partitionBy(key, "date").orderBy(F.when(F.col(weight) > 0, F.col(weight)).desc_nulls_last(), "contract")
    return F.when(F.col(weight) > 0, F.row_number().over(order))


def rank_features(df: DataFrame, weight: str, prefix: str, key: str = "product") -> DataFrame:
    """Per day: the contract of the largest weight, its share, the second's share (0 if none), and second / first."""
    ranked = df.withColumn("_rank", _ranked(df, weight, key))
    return ranked.groupBy(key, "date").agg(*_rank_aggregates(weight, prefix, "_rank"))


def _rank_aggregates(weight: str, prefix: str, rank: str) -> list[Column]:
    at = lambda n, c: F.max(F.when(F.col(rank) == n, F.col(c)))
    total, first = F.sum(F.when(F.col(weight) > 0, F.col(weight))), at(1, weight)
    second = F.coalesce(at(2, weight), F.lit(0.0))
    return [
        at(1, "contract").alias(f"dominant_{prefix}_contract"),
        F.try_divide(first, total).alias(f"dominant_{prefix}_share"),
        F.try_divide(second, total).alias(f"second_{prefix}_share"),
        F.try_divide(second, first).alias(f"{prefix}_roll_pressure"),
    ]


def dominant_changed(col: str, key: str | Sequence[str] = "product", null_is_change: bool = False) -> Column:
    """1 where col differs from the row before, 0 on the first row; two NULLs differ only on request."""
    w = W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy("date")
    before = F.lag(col).over(w)
    differs = ~F.col(col).eqNullSafe(before)
    if null_is_change:
        differs = differs | F.col(col).isNull()
    return F.when(F.row_number().over(w) == 1, 0).otherwise(differs.cast("int"))


def return_index(df: DataFrame, key: str, ref: str, ret: str, out: str = "return_index_close") -> DataFrame:
    """A level that starts at the first known ref and then follows ret (log percent).

    Where ret is missing the level is set to ref if that is known, else carried.
    Each start or reset opens a segment, and within one the level is the segment's
    ref times exp of the returns since, so no row depends on a computed one.
    """
    w = W.partitionBy(key).orderBy("date")
    seen = F.count(ref).over(w.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("_anchor", F.col(ref).isNotNull() & ((seen == 0) | F.col(ret).isNull()))
    df = df.withColumn("_segment", F.sum(F.col("_anchor").cast("int")).over(w))
    in_segment = W.partitionBy(key, "_segment").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    moved = F.sum(F.when(F.col("_anchor"), 0.0).otherwise(F.coalesce(ret, F.lit(0.0)))).over(in_segment)
    level = F.first(ref).over(in_segment) * F.exp(moved / 100)
    return df.withColumn(out, F.when(F.col("_segment") > 0, level)).drop("_anchor", "_segment")


def scanned_index(df: DataFrame, key: str, ref: str, ret: str, out: str = "return_index_close") -> DataFrame:
    """return_index of long series: no task holds one.

    With S the running sum of returns and a the last start or reset at or before a
    row, its level is ref(a) * exp((S - S(a)) / 100); both are carried from span to span.
    """
    known = F.col(ref).isNotNull()
    df = N.scanned(df, [key], {"_seen": ("sum", known.cast("long")), "_moved": ("sum", F.coalesce(ret, F.lit(0.0)))})
    anchor = F.when(known & ((F.col("_seen") == 1) | F.col(ret).isNull()), F.struct(F.col(ref).alias("ref"), F.col("_moved").alias("moved")))
    df = N.scanned(df, [key], {"_anchor": ("last", anchor)})
    level = F.col("_anchor.ref") * F.exp((F.col("_moved") - F.col("_anchor.moved")) / 100)
    return df.withColumn(out, level).drop("_seen", "_moved", "_anchor")


def rescale_ohlc(df: DataFrame, level: str = "return_index_close") -> DataFrame:
    """Open, high, low and settle of the index: the volume-weighted prices scaled to the level; close is the level."""
    scale = F.try_divide(F.col(level), F.col("volume_weighted_close"))
    out = {p: F.col(f"volume_weighted_{p}") * scale for p in PRICES if p != "close"}
    return df.withColumns(out | {"close": F.col(level)})


def build_index(df: DataFrame, key: str = "product", block_rows: int | None = None) -> DataFrame:
    """Contract bars (key, contract, date, measures) as one index row per key and date, 32 columns besides the key.

    With block_rows, no task after the daily sums holds a whole series.
    """
    rows = contract_returns(df, key)
    rows = rows.withColumns({f"_{name}_rank": _ranked(rows, weight, key) for weight, name in WEIGHTS.items()})
    ranks = [a for weight, name in WEIGHTS.items() for a in _rank_aggregates(weight, name, f"_{name}_rank")]
    days = rows.groupBy(key, "date").agg(*_total_aggregates(), *ranks)
    by = [key, "_block"] if block_rows else key
    days = N.haloed(days, [key], before=1, rows=block_rows) if block_rows else days
    days = days.withColumns(
        {
            "dominant_contract_changed": dominant_changed("dominant_oi_contract", by),
            "dominant_volume_contract_changed": dominant_changed("dominant_volume_contract", by),
        }
    )
    level = scanned_index if block_rows else return_index
    days = level(N.inside(days) if block_rows else days, key, "oi_weighted_close", "oi_weighted_return_pct")
    return rescale_ohlc(days)
