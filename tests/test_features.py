import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as B
from barloom.operators import features as X
from barloom.operators import folds as M
from barloom.operators import learn as L
from barloom.operators.clean import normalize_market

START = dt.date(2020, 1, 1)


def market(spark, n=90, extra=(), dataset="d", seed=None):
    rng = np.random.default_rng(seed)
    close = 101 + np.arange(n) if seed is None else 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    frame = pd.DataFrame({"date": [START + dt.timedelta(int(i)) for i in range(n)], "open": close, "high": close + 1, "low": close - 1, "close": close, "settle": close, "volume": 1000.0 + 10 * np.arange(n), "open_interest": 2000.0 + 5 * np.arange(n), "dataset": dataset})
    for c in extra:
        frame[c] = 1.0
    return spark.createDataFrame(frame.sample(frac=1, random_state=1)).withColumn("close", F.col("close").cast("double"))


def test_normalize_maps_hold_and_keeps_last(spark):
    rows = [("2024-01-02", "1", "2", "1", "1810", "5", "9000", "1", 1), ("2024-01-02", "1", "2", "1", "1811", "NaN", "9001", "x", 2)]
    df = spark.createDataFrame(rows, "date string, open string, high string, low string, close string, volume string, hold string, settle string, n int")
    (row,) = normalize_market(df, "jm_main", "n").collect()
    assert (row["open_interest"], row["dataset"], row["close"], row["volume"], row["settle"]) == (9001.0, "jm_main", 1811.0, None, None)
    assert row["date"] == dt.date(2024, 1, 2)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="settle"):
        normalize_market(spark.createDataFrame([(1, 2)], "date int, open int"), "x", "date")


def test_weighted_columns_become_features(spark):
    extra = ["dominant_volume_share", "active_contracts", "oi_weighted_close"]
    _, model, names = X.add_features(market(spark, extra=extra))
    assert {"dominant_volume_share", "active_contracts", "oi_volume_weighted_close_gap_pct"} <= set(names)
    assert len(names) == 24 + 3
    assert model.count() == 90 - 60 - 5  # sixty rows of history, five ahead


def test_horizon_names(spark):
    _, model, names = X.add_features(market(spark), horizon=10)
    assert "future_10d_return_pct" in model.columns and "future_5d_return_pct" not in model.columns and len(names) == 24
    assert X.prediction_column(10) == "pred_future_10d_return_pct"
    with pytest.raises(ValueError):
        X.add_features(market(spark), horizon=0)


def test_rolling_features_match_pandas(spark):
    rows, _, names = X.add_features(market(spark, 150, seed=3))
    got = rows.orderBy("date").toPandas().set_index("date")
    p = market(spark, 150, seed=3).toPandas().sort_values("date").set_index("date")
    ret = np.log(p.close / p.close.shift(1)) * 100
    want = {
        "volatility_20d_pct": ret.rolling(20).std(),
        "ma_gap_60d_pct": (p.close / p.close.rolling(60).mean() - 1) * 100,
        "open_interest_zscore_20d": (p.open_interest - p.open_interest.rolling(20).mean()) / p.open_interest.rolling(20).std(),
        "volume_change_5d_pct": np.log(p.volume / p.volume.shift(5)) * 100,
    }
    for name, series in want.items():
        np.testing.assert_allclose(got[name], series.loc[got.index], rtol=1e-9)
    assert len(got) == 150 - 60


def test_one_exchange_for_all_features(spark):
    rows, _, _ = X.add_features(market(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_folds_purge_and_do_not_overlap(spark):
    df = spark.createDataFrame([("d", START + dt.timedelta(i), float(i)) for i in range(700)], "dataset string, date date, x double")
    out = M.assign_folds(df, ["dataset"], 10, start_date=str(START + dt.timedelta(500)))
    table = M.fold_table(out, ["dataset"]).orderBy("fold").collect()
    assert [r["train_end"] for r in table] == [490, 553, 616, 679]
    assert table[0]["train_end_date"] == START + dt.timedelta(489)
    tested = out.filter("fold IS NOT NULL").orderBy("position").collect()
    assert [r["position"] for r in tested] == list(range(500, 700))
    ratio = M.assign_folds(df, ["dataset"], 10, start_date=None).filter("fold = 0").agg(F.min("position")).first()[0]
    assert ratio == 420


def test_first_fold_is_skipped_at_the_minimum(spark):
    df = spark.createDataFrame([("d", START + dt.timedelta(i)) for i in range(400)], "dataset string, date date")
    out = M.assign_folds(df, ["dataset"], 5, start_date=None, ratio=0.1)
    assert out.agg(F.min("fold"), F.min("start")).first()[:] == (1, 252)
    with pytest.raises(ValueError):
        M.require_folds(M.assign_folds(df.limit(100), ["dataset"], 5, start_date=None))


def test_ridge_folds_equal_direct_fits(spark):
    rng = np.random.default_rng(5)
    n = 420
    x = rng.normal(size=(n, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, n) + 3
    data = [("d", START + dt.timedelta(i), *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(data, "dataset string, date date, a double, b double, c double, target double")
    rows = M.assign_folds(df, ["dataset"], 5, start_date=None)
    got = L.walk_forward(rows, ["a", "b", "c"], "target", L.ridge(2.0)).orderBy("date").collect()
    for r in got:
        end = r["train_end"]
        gram = np.column_stack([np.ones(end), x[:end], y[:end]])
        beta, _ = L.solve_ridge(gram.T @ gram, 2.0)
        assert r["prediction"] == pytest.approx(beta @ [1, r["a"], r["b"], r["c"]], rel=1e-8)
    assert len(got) == n - 252 - (0 if got[0]["fold"] == 0 else 63)


def best_stump(x, y, l2, l1):
    """(gain, column, cut, low, high) of the best single split, by trying all."""
    soft = lambda g: np.sign(g) * max(abs(g) - l1, 0)
    r, best = y - y.mean(), (-1,)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            a, b = r[x[:, j] <= cut], r[x[:, j] > cut]
            gain = soft(a.sum()) ** 2 / (len(a) + l2) + soft(b.sum()) ** 2 / (len(b) + l2) - soft(r.sum()) ** 2 / (len(r) + l2)
            best = max(best, (gain, j, cut, soft(a.sum()) / (len(a) + l2), soft(b.sum()) / (len(b) + l2)))
    return best


def tree_rows(spark, n=400, key="d"):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 1] > 0.3, 2.0, -1.0) + rng.normal(0, 0.1, n)
    data = [(key, START + dt.timedelta(i), 1.0, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(data, "dataset string, date date, close double, a double, b double, c double, target double"), x, y


@pytest.mark.parametrize("key", ["d", None])
def test_tree_folds_equal_exhaustive_stumps(spark, key):
    df, x, y = tree_rows(spark, key=key)
    rows = M.assign_folds(df, ["dataset"], 5, start_date=None, test_rows=50)
    stump = L.gbt(trees=1, depth=1, rate=1.0, rows=1.0, columns=1.0, bins=1024)
    got = L.walk_forward(rows, ["a", "b", "c"], "target", stump).collect()
    assert len(got) == rows.filter("fold IS NOT NULL").count() > 60
    for r in got:
        end = r["train_end"]
        _, j, cut, low, high = best_stump(x[:end], y[:end], stump.l2, stump.l1)
        assert r["prediction"] == pytest.approx(y[:end].mean() + (low if r["abc"[j]] <= cut else high), rel=1e-9)


def test_deep_trees_fit_and_missing_values_are_large():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) * x[:, 2]
    train = np.arange(600) < 450
    found, shares = L.boost(x, y, train, L.gbt())
    assert 1 - ((found - y)[~train] ** 2).sum() / ((y - y[train].mean())[~train] ** 2).sum() > 0.75
    assert shares.sum() == pytest.approx(1) and shares.argmin() == 3
    assert np.array_equal(found, L.boost(x, y, train, L.gbt())[0])
    x[:, 3] = np.where(y > 0.5, np.nan, 0.0)
    found, shares = L.boost(x, y, train, L.gbt(trees=20))
    assert shares.argmax() == 3 and found[np.isnan(x[:, 3])].min() > found[~np.isnan(x[:, 3])].max() - 1


@pytest.mark.parametrize("learner", [L.ridge(), L.gbt(trees=30)])
def test_final_fit_and_top_features(spark, learner):
    df, x, y = tree_rows(spark)
    other, _, _ = tree_rows(spark, 300, "e")
    rows = df.unionByName(other)
    importance, latest = L.final_fit(rows, rows, ["a", "b", "c"], learner)
    top = L.top_features(importance, 1).collect()
    assert {(r["dataset"], r["feature"]) for r in top} == {("d", "b"), ("e", "b")}
    last = {r["dataset"]: r for r in latest.collect()}
    assert last["d"]["date"] == START + dt.timedelta(399) and last["e"]["date"] == START + dt.timedelta(299)
    assert last["d"]["signal"] == (1 if last["d"]["prediction"] > 0 else -1) == np.sign(y[-1])


def predictions(spark, rows):
    data = [("d", 5, START + dt.timedelta(i), 0.5, float(p), float(t)) for i, (p, t) in enumerate(rows)]
    return spark.createDataFrame(data, "dataset string, horizon int, date date, daily_return_pct double, prediction double, target double")


def test_forecast_quality_split(spark):
    out = {r["forecast"]: r for r in B.forecast_quality(predictions(spark, [(1, 2), (2, -1), (-1, -3), (-2, 1)])).collect()}
    assert (out["bullish"]["samples"], out["bullish"]["avg_realized_return_pct"], out["bullish"]["direction_accuracy"]) == (2, 0.5, 0.5)
    assert (out["bearish"]["avg_realized_return_pct"], out["bearish"]["direction_accuracy"], out["bearish"]["sample_share"]) == (-1.0, 0.5, 0.5)
    assert B.forecast_quality(predictions(spark, [(0, 0)])).first()["direction_accuracy"] == 0.0


def test_backtest_arithmetic(spark):
    bt = B.backtest(predictions(spark, [(1, 1), (1, 1), (-1, 1), (0, 1)])).orderBy("date").collect()
    assert [r["signal"] for r in bt] == [1, 1, -1, -1]
    assert [r["position"] for r in bt] == [0, 1, 1, -1]
    assert [r["turnover"] for r in bt] == [0, 1, 0, 2]
    assert bt[3]["strategy_daily_return_pct"] == pytest.approx(-0.5 - 2 * 0.02)
    m = B.metrics(B.backtest(predictions(spark, [(1, 1), (1, 1), (-1, 1), (0, 1)]))).first()
    assert m["trade_count"] == 2 and m["directional_accuracy"] == 0.5 and m["r2"] is None
    assert m["max_drawdown_pct"] == pytest.approx((np.exp(-0.54 / 100) - 1) * 100)
