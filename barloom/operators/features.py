"""Rolling and lagged features with forward-return labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from barloom.functions import columns as C
from barloom.operators import longseries as N
from barloom.operators.clean import WEIGHTED

RETURNS, WINDOWS, CHANGES, SCORES = (1, 2, 3, 5, 10, 20), (5, 10, 20, 60), (1, 5, 20), (20, 60)


def target_column(horizon: int) -> str:
    return f"future_{horizon}d_return_pct"


def direction_column(horizon: int) -> str:
    return f"future_{horizon}d_up"


def prediction_column(horizon: int) -> str:
    return f"pred_future_{horizon}d_return_pct"


def feature_columns(columns: Sequence[str]) -> list[str]:
    """The features that a frame with these columns gets."""
    names = [f"return_{n}d_pct" for n in RETURNS]
    names += [f"{kind}_{n}d_pct" for n in WINDOWS for kind in ("volatility", "ma_gap")]
    names += [f"{kind}_change_{n}d_pct" for n in CHANGES for kind in ("volume", "open_interest")]
    names += [f"open_interest_zscore_{n}d" for n in SCORES]
    names += ["intraday_range_pct", "settle_close_spread_pct"]
    if "oi_weighted_close" in columns:
        names.append("oi_volume_weighted_close_gap_pct")
    return names + [c for c in WEIGHTED if c in columns]


def _known(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """dropna, with a condition for each column: one on all of them doubles in the optimizer with every column renamed."""
    for n in names:
        df = df.filter(F.col(n).isNotNull())
    return df


def _with_features(df: DataFrame, key: Sequence[str], ahead: Callable[[WindowSpec], dict[str, Column]], reach: int, block_rows: int | None, has_weighted: Column | None) -> tuple[DataFrame, list[str]]:
    """Rows with all features known, and the features' names; ahead gives columns that look at most ``reach`` rows ahead.

    All windows share one partitioning and order: a series, or blocks of block_rows
    rows of it with the rows that their windows reach. has_weighted says for each row
    whether its series has the optional columns; where not, they need not be known.
    """
    if block_rows:
        df, key = N.haloed(df, key, before=max(WINDOWS), after=reach, rows=block_rows), [*key, "_block"]
    w = W.partitionBy(*key).orderBy("date")
    out = df.withColumns({"_volume": C.zero_to_null("volume"), "_oi": C.zero_to_null("open_interest")})
    out = out.withColumn("daily_return_pct", C.log_return("close", 1, w))
    new = {f"return_{n}d_pct": C.log_return("close", n, w) for n in RETURNS}
    for n in WINDOWS:
        new |= {f"volatility_{n}d_pct": C.rolling_vol("daily_return_pct", n, w), f"ma_gap_{n}d_pct": C.ma_gap("close", n, w)}
    for n in CHANGES:
        new |= {f"volume_change_{n}d_pct": C.log_return("_volume", n, w), f"open_interest_change_{n}d_pct": C.log_return("_oi", n, w)}
    new |= {f"open_interest_zscore_{n}d": C.rolling_zscore("_oi", n, w) for n in SCORES}
    new |= {
        "intraday_range_pct": F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 100,
        "settle_close_spread_pct": C.share_pct("settle", "close"),
        **ahead(w),
    }
    if "oi_weighted_close" in df.columns:
        new["oi_volume_weighted_close_gap_pct"] = C.share_pct("oi_weighted_close", "close")
    out = out.withColumns(new).drop("_volume", "_oi")
    out = N.inside(out) if block_rows else out
    names = feature_columns(df.columns)
    if has_weighted is None:
        return _known(out, names), names
    optional = [n for n in names if n in WEIGHTED or n == "oi_volume_weighted_close_gap_pct"]
    filled = out.withColumns({n: F.when(has_weighted, F.col(n)).otherwise(0) for n in optional})
    filled = _known(filled, names)
    return filled.withColumns({n: F.when(has_weighted, F.col(n)) for n in optional}), names


def add_features(df: DataFrame, key: Sequence[str] = ("dataset",), horizon: int = 5, block_rows: int | None = None, has_weighted: Column | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Feature rows (all features known), model rows (the target too), and the features' names.

    df is a normalised market frame. With block_rows (61 at least) a series is cut
    into so many rows each, so that a long one is many tasks; the result is the same.
    """
    target = target_column(horizon)
    features, names = _with_features(df, key, lambda w: {target: C.forward_return("close", horizon, w)}, horizon, block_rows, has_weighted)
    features = features.withColumn(direction_column(horizon), C.direction(target))
    return features, features.dropna(subset=[target]), names


def add_horizons(df: DataFrame, key: Sequence[str] = ("dataset",), horizons: Sequence[int] = (5, 10), block_rows: int | None = None, has_weighted: Column | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """add_features for several horizons in one pass: horizon is a column of the model rows, and so can be a key.

    Feature rows have targets, an array of (horizon, target); model rows are one per
    horizon with a known target: horizon, target and up.
    """
    ahead = lambda w: {"targets": F.array(*[F.struct(F.lit(h).alias("horizon"), C.forward_return("close", h, w).alias("target")) for h in horizons])}
    features, names = _with_features(df, key, ahead, max(horizons), block_rows, has_weighted)
    rows = features.withColumn("_of", F.explode("targets")).drop("targets").withColumns({"horizon": F.col("_of.horizon"), "target": F.col("_of.target")}).drop("_of")
    return features, rows.filter("target IS NOT NULL").withColumn("up", C.direction("target")), names


def labelled(df: DataFrame, horizon: int) -> DataFrame:
    """Model rows with the horizon's target, direction and horizon under common names, so that horizons can be a key."""
    return df.withColumnsRenamed({target_column(horizon): "target", direction_column(horizon): "up"}).withColumn("horizon", F.lit(horizon))
