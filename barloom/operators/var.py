"""Unit roots and vector autoregressions from Gram sums, one small solve per series or panel.

Formulas: Luetkepohl, New Introduction to Multiple Time Series Analysis (2005);
Dickey and Fuller (1979); p-values after MacKinnon (1994).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from barloom.operators.learn import gram_matrix, gram_sums

#: MacKinnon (1994), constant only, one series: the statistic where the branches meet, then polynomials in it.
_SPLIT = -1.61
_LOW = (2.1659, 1.4412, 0.038269)
_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
_MOST, _LEAST = 2.74, -18.83


def adf_p_value(stat: float) -> float:
    """Chance of a statistic this low or lower under a unit root (regression with a constant)."""
    if stat > _MOST:
        return 1.0
    if stat < _LEAST:
        return 0.0
    z = sum(c * stat**i for i, c in enumerate(_LOW if stat <= _SPLIT else _HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _regression(gram: np.ndarray, x: Sequence[int], y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, squared error and inverse of least squares of column y on columns x of a Gram matrix."""
    inverse = np.linalg.pinv(gram[np.ix_(x, x)])
    beta = inverse @ gram[x, y]
    return beta, float(gram[y, y] - beta @ gram[x, y]), inverse


def lagged(df: DataFrame, key: Sequence[str], cols: Sequence[str], lags: int) -> tuple[DataFrame, list[str]]:
    """df with <col>_l<p> for p up to lags, and the names: all columns at lag 1 first, then lag 2, ..."""
    w = W.partitionBy(*key).orderBy("date")
    names = {f"{c}_l{p}": F.lag(c, p).over(w) for p in range(1, lags + 1) for c in cols}
    return df.withColumns(names) if names else df, list(names)


def adf(df: DataFrame, key: Sequence[str], col: str, max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test per key: adf_stat, p_value, used_lag, nobs, stationary_at_5pct.

    Lags go up to ceil(12 (n/100)^(1/4)), at most n/2 - 2; AIC picks one on the
    sample that all share, and the test is made on the largest sample of that lag.
    Both come from Gram sums per candidate sample, so a series is never gathered.
    Series too short for a test, or constant ones, have NULLs.
    """
    w = W.partitionBy(*key).orderBy("date")
    rows = df.filter(F.col(col).isNotNull()).select(*key, "date", F.col(col).cast("double").alias("y"))
    rows = rows.withColumns({"n": F.count("*").over(W.partitionBy(*key)), "at": F.row_number().over(w) - 1, "level": F.lag("y").over(w)})
    rows = rows.withColumn("dy", F.col("y") - F.col("level"))
    longest = rows.agg(F.max("n")).first()[0] or 0
    top = max(0, min(math.ceil(12 * (longest / 100) ** 0.25), longest // 2 - 2)) if max_lag is None else max_lag
    rows, names = lagged(rows, key, ["dy"], top)
    own = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2) if max_lag is None else F.lit(max_lag)
    rows = rows.withColumn("own", F.greatest(own, F.lit(0)).cast("int")).filter("at >= 1")
    # Row `at` has at - 1 lagged differences; it is in the samples of all lags below that.
    columns = ["dy", "level", *names]
    rows = rows.fillna(0.0, subset=columns).withColumn("lags", F.least(F.col("at") - 1, F.col("own")))
    sums = gram_sums(rows, [*key, "own", "n", "lags"], columns)
    schema = T.StructType(
        [
            *(df.schema[k] for k in key),
            T.StructField("adf_stat", T.DoubleType()),
            T.StructField("p_value", T.DoubleType()),
            T.StructField("used_lag", T.IntegerType()),
            T.StructField("nobs", T.LongType()),
            T.StructField("stationary_at_5pct", T.BooleanType()),
        ]
    )

    def test(values: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        size, own_top = len(columns) + 1, int(frame["own"].iloc[0])
        by_lags = {int(p): gram_matrix(part, size) for p, part in frame.groupby("lags")}
        sample = lambda p: sum((g for q, g in by_lags.items() if q >= p), np.zeros((size, size)))
        regressors = lambda p: [0, 2, *range(3, 3 + p)]
        shared = sample(own_top)
        best, lag = math.inf, 0
        for p in range(own_top + 1):
            error, nobs = _regression(shared, regressors(p), 1)[1], shared[0, 0]
            if error > 0 and nobs > p + 2:
                aic = nobs * (math.log(2 * math.pi * error / nobs) + 1) + 2 * (p + 2)
                best, lag = (aic, p) if aic < best else (best, lag)
        gram = sample(lag)
        x, nobs = regressors(lag), int(gram[0, 0])
        beta, error, inverse = _regression(gram, x, 1)
        spread = error / (nobs - len(x)) * inverse[1, 1] if nobs > len(x) else 0
        if best == math.inf or spread <= 0:
            return pd.DataFrame([[*values, None, None, None, nobs, None]], columns=schema.names)
        stat = float(beta[1] / math.sqrt(spread))
        p = adf_p_value(stat)
        return pd.DataFrame([[*values, stat, p, lag, nobs, p < 0.05]], columns=schema.names)

    return sums.groupBy(*key).applyInPandas(test, schema)


def var_gram(df: DataFrame, key: Sequence[str], cols: Sequence[str], max_lag: int) -> DataFrame:
    """Gram sums of [1, cols, cols at lag 1, ...] per key and number of lags that a row has (up to max_lag)."""
    known = df.dropna(subset=list(cols))
    rows, names = lagged(known, key, cols, max_lag)
    at = F.row_number().over(W.partitionBy(*key).orderBy("date")) - 1
    rows = rows.withColumn("lags", F.least(at, F.lit(max_lag)).cast("int")).fillna(0.0, subset=names)
    return gram_sums(rows, [*key, "lags"], [*cols, *names])


def _fit(gram: np.ndarray, k: int, lag: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (constant, then lags; one column per equation), SSR matrix and sample size."""
    x, y = [0, *range(1 + k, 1 + k + k * lag)], list(range(1, 1 + k))
    beta = np.linalg.pinv(gram[np.ix_(x, x)]) @ gram[np.ix_(x, y)]
    return beta, gram[np.ix_(y, y)] - gram[np.ix_(y, x)] @ beta, float(gram[0, 0])


_VAR = "lag_order int, nobs long, cols array<string>, coefficients array<array<double>>, sigma array<array<double>>, aic array<double>"


def var_fit(df: DataFrame, key: Sequence[str], cols: Sequence[str], max_lag: int = 10) -> DataFrame:
    """A VAR with constant per key, lag chosen by AIC: lag_order, nobs, cols, coefficients, sigma, aic (by lag from 0).

    The largest lag tried is min(max_lag, max(1, n // 50)); a choice of 0 counts as 1.
    """
    cols = list(cols)
    sums = var_gram(df, key, cols, max_lag)
    schema = T.StructType([*(df.schema[c] for c in key), *T._parse_datatype_string(_VAR).fields])

    def fit(values: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        k, size = len(cols), 1 + len(cols) * (max_lag + 1)
        by_lags = {int(p): gram_matrix(part, size) for p, part in frame.groupby("lags")}
        sample = lambda p: sum((g for q, g in by_lags.items() if q >= p), np.zeros((size, size)))
        n = int(sample(0)[0, 0])
        top = min(max_lag, max(1, n // 50))
        # The lags of the common sample: rows with at least `top` predecessors.
        aic = []
        for p in range(top + 1):
            _, ssr, t = _fit(sample(top), k, p)
            sign, logdet = np.linalg.slogdet(ssr / t) if t else (0, 0.0)
            aic.append(logdet + 2 * (p * k * k + k) / t if sign > 0 else math.inf)
        lag = max(1, int(np.argmin(aic)))
        beta, ssr, t = _fit(sample(lag), k, lag)
        sigma = ssr / max(1.0, t - k * lag - 1)
        return pd.DataFrame([[*values, lag, int(t), cols, beta.tolist(), sigma.tolist(), aic]], columns=schema.names)

    return sums.groupBy(*key).applyInPandas(fit, schema)


def orth_irf(fit: DataFrame, key: Sequence[str], steps: int = 20) -> DataFrame:
    """(key, response, shock, step, value): Cholesky-orthogonalised impulse responses at steps 0 to steps."""
    schema = T.StructType([*(fit.schema[c] for c in key), *T._parse_datatype_string("response string, shock string, step int, value double").fields])

    def respond(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            for row in frame.itertuples(index=False):
                beta = np.array([list(b) for b in row.coefficients])
                k = len(row.cols)
                a = [beta[1 + i * k : 1 + (i + 1) * k].T for i in range(int(row.lag_order))]
                root = np.linalg.cholesky(np.array([list(s) for s in row.sigma]))
                psi = [np.eye(k)]
                for i in range(1, steps + 1):
                    psi.append(sum((psi[i - j] @ a[j - 1] for j in range(1, min(i, len(a)) + 1)), np.zeros((k, k))))
                names = list(row.cols)
                own = [getattr(row, c) for c in key]
                out = [[*own, names[r], names[s], i, float((p @ root)[r, s])] for i, p in enumerate(psi) for r in range(k) for s in range(k)]
                yield pd.DataFrame(out, columns=schema.names)

    return fit.select(*key, "lag_order", "cols", "coefficients", "sigma").mapInPandas(respond, schema)


def irf_summary(irf: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Per response and shock: the response on day 0, the first largest later one and its day, and the later sum."""
    later = F.col("step") > 0
    rank = F.when(later, F.struct(F.abs("value").alias("size"), (-F.col("step")).alias("early")))
    return irf.groupBy(*key, "response", "shock").agg(
        F.max(F.when(F.col("step") == 0, F.col("value"))).alias("day0_response"),
        F.max_by("step", rank).alias("peak_abs_day"),
        F.max_by("value", rank).alias("peak_response"),
        F.sum(F.when(later, F.col("value"))).alias("cumulative_response"),
    )


def fevd(irf: DataFrame, horizons: Sequence[int] = (1, 5, 10, 20), key: Sequence[str] = ()) -> DataFrame:
    """(key, target, horizon_days, shock, share_pct): forecast error variance shares.

    Horizon h counts from 0, so it takes the responses of steps 0 to h, h + 1 in all.
    """
    upto = W.partitionBy(*key, "response", "shock").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    rows = irf.withColumn("_sum", F.sum(F.col("value") * F.col("value")).over(upto)).filter(F.col("step").isin(*horizons))
    total = F.sum("_sum").over(W.partitionBy(*key, "response", "step"))
    share = F.try_divide(F.col("_sum"), total) * 100
    return rows.select(*key, F.col("response").alias("target"), F.col("step").alias("horizon_days"), "shock", share.alias("share_pct"))


def fevd_at(table: DataFrame, horizon: int = 20) -> DataFrame:
    return table.filter(F.col("horizon_days") == horizon)


def top_cross_irf(summary: DataFrame, k: int = 5) -> DataFrame:
    """The k pairs of different series with the largest cumulative response."""
    cross = summary.filter(F.col("response") != F.col("shock"))
    return cross.orderBy(F.abs("cumulative_response").desc(), "response", "shock").limit(k)
