"""Several series side by side: wide features, correlations, dashboards."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions import columns as C
from barloom.functions.guards import unique
from barloom.operators import longseries as N


def require_unique(df: DataFrame, key: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """df, if no key occurs twice; else ValueError."""
    if not df.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated rows of one {tuple(key)}")
    return df


def pivot_field(df: DataFrame, field: str, symbols: Sequence[str], check: bool | str = True) -> DataFrame:
    """date and one column per symbol, in the given order; repeated (symbol, date) rows are an error.

    check: True looks for them at once, "plan" when the result is read, False never.
    """
    if check == "plan":
        df = unique(df, ("symbol", "date"))
    elif check:
        require_unique(df)
    return df.groupBy("date").pivot("symbol", list(symbols)).agg(F.first(field))


def on_common_dates(df: DataFrame, symbols: Sequence[str], field: str = "close") -> DataFrame:
    """The rows of dates on which all symbols have the field."""
    known = df.filter(F.col("symbol").isin(*symbols) & F.col(field).isNotNull())
    dates = known.groupBy("date").agg(F.count_distinct("symbol").alias("n")).filter(F.col("n") == len(symbols)).select("date")
    return known.join(dates, "date", "left_semi")


def common_features(df: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Long form of wide_features: per symbol and common date close, ret, vol20, volume_chg and hold_chg.

    Returns span the gaps between common dates. A date on which any symbol's
    return is unknown leaves the return panel before vol20 is taken.
    """
    w = W.partitionBy("symbol").orderBy("date")
    rows = on_common_dates(df, symbols).withColumns({"_v": C.zero_to_null("volume"), "_h": C.zero_to_null("hold")})
    ln = lambda c: F.ln(F.when(F.col(c) > 0, F.col(c)))
    rows = rows.withColumns(
        {
            "_ret": (ln("close") - F.lag(ln("close")).over(w)) * 100,
            "volume_chg": (ln("_v") - F.lag(ln("_v")).over(w)) * 100,
            "hold_chg": (ln("_h") - F.lag(ln("_h")).over(w)) * 100,
        }
    )
    rows = rows.withColumn("_known", F.count("_ret").over(W.partitionBy("date")) == len(symbols))
    panel = W.partitionBy("symbol", "_known").orderBy("date")
    vol = F.when(F.col("_known"), C.rolling_vol("_ret", 20, panel))
    return rows.withColumns({"ret": F.when(F.col("_known"), F.col("_ret")), "vol20": vol}).select("symbol", "date", "close", "ret", "vol20", "volume_chg", "hold_chg")


def wide_features(df: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """One row per common date: close_, ret_, vol20_, volume_chg_ and hold_chg_ columns of each symbol."""
    kinds = ("close", "ret", "vol20", "volume_chg", "hold_chg")
    long = common_features(df, symbols)
    wide = long.groupBy("date").pivot("symbol", list(symbols)).agg(*[F.first(k).alias(k) for k in kinds])
    return wide.select("date", *[F.col(f"`{s}_{k}`").alias(f"{k}_{s}") for s in symbols for k in kinds])


def price_index(df: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Adds price_index: close as percent of the key's first."""
    first = F.first("close").over(W.partitionBy(*key).orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn("price_index", F.try_divide(F.col("close"), first) * 100)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(left, right, correlation) of all pairs, each over the rows where both are known; one aggregation."""
    pairs = [(a, b) for a in cols for b in cols]
    found = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"`{a}|{b}`").alias("correlation")) for a, b in pairs])
    return found.select(F.explode(rows).alias("of")).select("of.*")


def rolling_corr(df: DataFrame, pairs: Sequence[tuple[str, str]], n: int = 60, key: Sequence[str] = (), block_rows: int = N.BLOCK) -> DataFrame:
    """date and, per pair, corr_<a>_<b> over the last n rows; NULL unless both are known in all of them.

    The rows of a key, or all rows, are cut into blocks with the n - 1 rows before each.
    """
    df = N.haloed(df, key, before=n - 1, rows=max(block_rows, n))
    rows = W.partitionBy(*key, "_block").orderBy("date").rowsBetween(-(n - 1), 0)
    out = {f"corr_{a}_{b}": F.when(F.count(F.when(F.col(a).isNotNull(), F.col(b))).over(rows) == n, F.corr(a, b).over(rows)) for a, b in pairs}
    return df.select(*key, "date", "_inside", *[c.alias(name) for name, c in out.items()]).filter("_inside").drop("_inside")


def all_pairs(symbols: Sequence[str], prefix: str = "ret_") -> list[tuple[str, str]]:
    return [(prefix + a, prefix + b) for a, b in combinations(symbols, 2)]


def dashboard(long: DataFrame, key: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key, from common_features: last date and close, sums of the last 5 and 20 returns, last known vol20."""
    known = F.row_number().over(W.partitionBy(*key).orderBy(F.col("ret").isNull(), F.col("date").desc()))
    rows = long.withColumn("_at", F.when(F.col("ret").isNotNull(), known))
    sums = [F.sum(F.when(F.col("_at") <= n, F.col("ret"))).alias(f"return_{n}d_pct") for n in (5, 20)]
    return rows.groupBy(*key).agg(
        F.max("date").alias("latest_date"),
        F.max_by("close", "date").alias("latest_close"),
        *sums,
        F.max_by("vol20", F.when(F.col("vol20").isNotNull(), F.col("date"))).alias("volatility_20d_pct"),
    )
