import datetime as dt
import json

import numpy as np
import pytest

from barloom.operators import calendar as K
from barloom.operators import panel as A
from barloom.operators import signals as S
from barloom.operators import var as V
from barloom.sources.schemas import validate_columns

START = dt.date(2020, 1, 1)


def days(n):
    return [START + dt.timedelta(i) for i in range(n)]


def test_contract_codes(spark):
    out = K.contract_symbols(spark.createDataFrame([("I",), ("JM",)], "code string"), 2026, 2026).collect()
    names = [r["contract"] for r in out if r["product"] == "JM"]
    assert names[0] == "JM2601" and names[-1] == "JM2612" and len(out) == 24
    assert {r["period"] for r in out if r["contract"] == "I2603"} == {dt.date(2026, 3, 1)}


def test_refresh_plan_skips_settled_cached(spark):
    symbols = spark.createDataFrame([("A2301", dt.date(2023, 1, 1)), ("A2302", dt.date(2023, 2, 1)), ("A2401", dt.date(2024, 1, 1)), ("A2303", dt.date(2023, 3, 1))], "contract string, period date")
    manifest = spark.createDataFrame([("A2301", 10), ("A2302", 0), ("A2401", 5)], "contract string, rows long")
    plan = lambda **k: {r["contract"]: r["refetch"] for r in K.refresh_plan(symbols, manifest, "2024-01-15", **k).collect()}
    assert plan() == {"A2301": False, "A2302": True, "A2401": True, "A2303": True}
    assert all(plan(force=True).values())


def test_previous_session_over_a_holiday(spark):
    calendar = spark.createDataFrame([(dt.date(2026, 9, 29),), (dt.date(2026, 9, 30),), (dt.date(2026, 10, 9),), (dt.date(2026, 9, 30),)], "trade_date date")
    ask = lambda *d: {r["date"]: (r["is_trading_day"], r["previous_session"]) for r in K.previous_session(spark.createDataFrame([(x,) for x in d], "date date"), calendar).collect()}
    assert ask(dt.date(2026, 10, 1), dt.date(2026, 10, 9)) == {dt.date(2026, 10, 1): (False, dt.date(2026, 9, 30)), dt.date(2026, 10, 9): (True, dt.date(2026, 9, 30))}
    assert ask(dt.date(2027, 1, 2)) == {dt.date(2027, 1, 2): (False, dt.date(2026, 10, 9))}
    with pytest.raises(Exception, match="no session before"):
        ask(dt.date(2026, 9, 29))


def test_validate_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert validate_columns(df, ["b"]) is df
    for wrong in (["b", "a"], ["a"]):
        with pytest.raises(ValueError):
            validate_columns(df, wrong, exact=True)


def test_pivot_refuses_repeats(spark):
    df = spark.createDataFrame([("A", START, 1.0), ("A", START, 2.0)], "symbol string, date date, close double")
    with pytest.raises(ValueError):
        A.pivot_field(df, "close", ["A"])


def test_var_recovers_coefficients_and_fevd_sums_to_100(spark):
    rng = np.random.default_rng(0)
    a = np.array([[0.5, 0.1], [0.0, 0.3]])
    y = np.zeros((4000, 2))
    for i in range(1, len(y)):
        y[i] = a @ y[i - 1] + rng.normal(size=2)
    df = spark.createDataFrame([("p", d, *map(float, v)) for d, v in zip(days(len(y)), y, strict=True)], "panel string, date date, u double, v double").repartition(5)
    fit = V.var_fit(df, ["panel"], ["u", "v"], max_lag=3).first()
    assert fit["lag_order"] == 1 and fit["nobs"] == 3999
    x = np.column_stack([np.ones(3999), y[:-1]])
    np.testing.assert_allclose(np.array(fit["coefficients"]), np.linalg.lstsq(x, y[1:], rcond=None)[0], atol=1e-8)
    irf = V.orth_irf(V.var_fit(df, ["panel"], ["u", "v"], max_lag=3), ["panel"], 20)
    at = {(r["response"], r["shock"], r["step"]): r["value"] for r in irf.collect()}
    assert at["u", "v", 0] == 0 and at["u", "u", 0] > 0
    total = {}
    for r in V.fevd(irf, key=["panel"]).collect():
        total[r["target"], r["horizon_days"]] = total.get((r["target"], r["horizon_days"]), 0) + r["share_pct"]
    assert all(v == pytest.approx(100) for v in total.values()) and len(total) == 8
    summary = V.irf_summary(irf, ["panel"]).filter("response = 'u' AND shock = 'u'").first()
    assert summary["peak_abs_day"] == 1
    assert V.top_cross_irf(V.irf_summary(irf, ["panel"])).count() == 2


def test_adf_tells_walks_from_noise(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=600)
    rows = [(n, d, float(v)) for n, s in (("noise", noise), ("walk", np.cumsum(noise))) for d, v in zip(days(600), s, strict=True)]
    rows += [("short", START, 1.0), ("flat", START, 1.0)]
    out = {r["k"]: r for r in V.adf(spark.createDataFrame(rows, "k string, date date, y double"), ["k"], "y").collect()}
    assert out["noise"]["stationary_at_5pct"] and not out["walk"]["stationary_at_5pct"]
    assert V.adf_p_value(-2.86) == pytest.approx(0.05, abs=1e-3) and V.adf_p_value(-3.43) == pytest.approx(0.01, abs=1e-3)


def test_payload(spark):
    latest = spark.createDataFrame([("JM", 5, dt.date(2026, 9, 30), 100.0, 1.25, 1), ("JM", 10, dt.date(2026, 9, 30), 100.0, -0.75, -1)], "product string, horizon int, date date, close double, prediction double, signal int")
    quality = spark.createDataFrame([("JM", 5, "bullish", 1, 1.0, 1.0), ("JM", 5, "bearish", 1, -3.0, 1.0)], "product string, horizon int, forecast string, samples long, avg_realized_return_pct double, direction_accuracy double")
    found = S.assert_one_source_date(S.latest_signals(latest, quality))
    calendar = spark.createDataFrame([(dt.date(2026, 9, 30),)], "trade_date date")
    doc = json.loads(S.payload(found, calendar, "2026-10-01", "now").first()["value"])
    assert doc["schema_version"] == 1 and doc["expected_source_date"] == "2026-09-30" and doc["is_trading_day"] is False
    forecasts = doc["products"]["JM"]["forecasts"]
    assert forecasts["5"]["direction"] == "bullish" and forecasts["5"]["quality"]["samples"] == 1
    assert forecasts["10"]["direction"] == "bearish" and forecasts["10"]["quality"] is None
    later = latest.withColumn("date", latest["date"] + latest["horizon"])
    with pytest.raises(ValueError, match="JM"):
        S.assert_one_source_date(S.latest_signals(later, quality))
