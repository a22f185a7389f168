"""Blocks, carried scans, medians and checks inside the plan, at and beside block borders."""

import datetime as dt
import json
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barloom.functions.guards import some_rows, unique
from barloom.operators import backtest as B
from barloom.operators import clean as P
from barloom.operators import features as X
from barloom.operators import folds as M
from barloom.operators import index as I
from barloom.operators import learn as L
from barloom.operators import longseries as N
from barloom.operators import panel as A
from barloom.operators import signals as S
from barloom.operators import var as V
from barloom.sources import bars as IO

START = dt.date(2020, 1, 1)


def series(spark, n=400, names=("d", None), seed=1):
    """Every third day or so, in any order; one series has no name."""
    rng, rows = np.random.default_rng(seed), []
    for name in names:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        day = START
        for i in range(n):
            day += dt.timedelta(int(rng.integers(1, 6)))
            c = float(close[i])
            rows.append((name, day, c, c + 1, c - 1, c, 1000.0 + i, c + 0.5, 2000.0 + 3 * i))
    rng.shuffle(rows)
    schema = "dataset string, date date, open double, high double, low double, close double, volume double, settle double, open_interest double"
    return spark.createDataFrame([(r[0], r[1], *map(float, r[2:])) for r in rows], schema).repartition(3)


def same(a, b):
    text = lambda df: sorted(str([None if v is None else f"{v:.10g}" if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(df.columns)).collect())
    assert sorted(a.columns) == sorted(b.columns) and text(a) == text(b)


@pytest.mark.parametrize("rows", [60, 61, 100, 5000])
def test_features_by_blocks(spark, rows):
    df = series(spark)
    plain, model, names = X.add_features(df, horizon=5)
    blocks, block_model, _ = X.add_features(df, horizon=5, block_rows=rows)
    same(plain.select("dataset", "date", *names), blocks.select("dataset", "date", *names))
    same(model, block_model)
    with pytest.raises(ValueError):
        X.add_features(df, block_rows=59)


def test_horizons_as_a_key(spark):
    df = series(spark, 200)
    _, rows, names = X.add_horizons(df, horizons=(5, 10), block_rows=64)
    for h in (5, 10):
        want = X.labelled(X.add_features(df, horizon=h)[1], h)
        same(want, rows.filter(F.col("horizon") == h).select(*want.columns))
    folded = M.assign_folds(rows.persist(), B.KEY, "horizon", start_date=None, min_train=50)
    ends = folded.filter("fold = 0").groupBy("dataset", "horizon").agg(F.first("start").alias("start"), F.first("train_end").alias("end")).collect()
    assert len(ends) == 4 and all(r["start"] - r["end"] == r["horizon"] for r in ends)


def test_places_and_halos(spark):
    df = series(spark, 100, ("a",))
    got = sorted((r["date"], r["_place"]) for r in N.placed(df, ["dataset"], span=30).collect())
    assert [p for _, p in got] == list(range(100))
    blocks = N.haloed(df, ["dataset"], before=2, after=1, rows=10).groupBy("_block").agg(F.count("*").alias("n"), F.count_if("_inside").alias("own")).orderBy("_block").collect()
    assert [(r["n"], r["own"]) for r in blocks] == [(11, 10), *[(13, 10)] * 8, (12, 10), (2, 0)]


def test_scans(spark):
    rows = [("a", START + dt.timedelta(40 * i), float(v) if v is not None else None) for i, v in enumerate([None, 3, -1, None, 7, 2, None, 9])]
    df = spark.createDataFrame(rows + [(None, START, 5.0)], "k string, date date, v double")
    out = N.scanned(df, ["k"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, span=70).orderBy("date")
    got = [(r["s"], r["m"], r["l"]) for r in out.filter("k = 'a'").collect()]
    assert got == [(None, None, None), (3, 3, 3), (2, 3, -1), (2, 3, -1), (9, 7, 7), (11, 7, 2), (11, 7, 2), (20, 9, 9)]
    assert out.filter("k IS NULL").first()["s"] == 5


@pytest.mark.parametrize("rows", [2, 63, 1000])
def test_backtest_and_metrics_by_blocks(spark, rows):
    rng = np.random.default_rng(3)
    data = [(k, 5, START + dt.timedelta(3 * i), *map(float, rng.normal(size=3))) for k in ("d", "e") for i in range(200)]
    pred = spark.createDataFrame(data, "dataset string, horizon int, date date, daily_return_pct double, prediction double, target double").repartition(3)
    same(B.backtest(pred), B.backtest(pred, block_rows=rows))
    same(B.metrics(B.backtest(pred)), B.metrics(B.backtest(pred, block_rows=rows), long=True))


def test_index_levels_by_spans(spark):
    rng = np.random.default_rng(4)
    some = lambda p, v: None if rng.random() < p else float(v)
    rows = [(k, START + dt.timedelta(9 * i), some(0.3, 50 + i), some(0.4, rng.normal())) for k in ("x", "y") for i in range(150)] + [("z", START, None, 1.0)]
    df = spark.createDataFrame(rows, "product string, date date, ref double, ret double")
    same(I.return_index(df, "product", "ref", "ret"), I.scanned_index(df, "product", "ref", "ret"))


@pytest.mark.parametrize("buckets", [2, 5, 4096])
def test_medians(spark, buckets):
    rng = np.random.default_rng(6)
    groups = {"odd": rng.normal(size=101), "even": rng.normal(size=100), "ties": np.repeat([1.0, 2.0, 3.0], [5, 90, 5]), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "skew": np.append(rng.normal(size=50) * 1e-9, 1e300), "wide": np.array([-1.7e308, 0.0, 1.7e308]), None: np.arange(7.0)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: r["m"] for r in N.median(df, ["k"], "v", "m", buckets=buckets).collect()}
    assert got == {k: pytest.approx(float(np.median(v)), rel=1e-12) for k, v in groups.items()}


def test_rolling_corr_by_blocks(spark):
    rng = np.random.default_rng(7)
    rows = [(START + dt.timedelta(i), float(a), None if i == 40 else float(b)) for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    df = spark.createDataFrame(rows, "date date, a double, b double")
    got = A.rolling_corr(df, [("a", "b")], n=10, block_rows=16)
    frame = df.toPandas().set_index("date")
    want = frame["a"].rolling(10).corr(frame["b"])
    for r in got.collect():
        assert r["corr_a_b"] is None if np.isnan(want[r["date"]]) else r["corr_a_b"] == pytest.approx(want[r["date"]])
    assert got.count() == 150 and "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString().split("Window")[1]


def text_rows(spark, bad):
    good = [(str(START + dt.timedelta(i)), *["1.5"] * 7, i) for i in range(90)]
    return spark.createDataFrame([*good, *bad], "date string, open string, high string, low string, close string, volume string, settle string, hold string, n int")


def test_bad_dates_never_enter_a_window(spark):
    df = text_rows(spark, [("no date", "1", "1", "1", "999", "x", "1", "inf", 91), (None, "1", "1", "1", "999", "1", "NaN", "1", 92)])
    seen = Observation()
    out = P.normalize_market(df, "d", "n", on_bad="drop", rejects=seen)
    assert out.count() == 90 and out.filter("date IS NULL OR close = 999").count() == 0
    assert (seen.get["bad_dates"], seen.get["bad_volume"], seen.get["bad_open_interest"], seen.get["bad_settle"], seen.get["bad_close"]) == (1, 1, 1, 1, 0)
    with pytest.raises(Exception, match="not a date: no date"):
        P.normalize_market(df, "d", "n").collect()
    with pytest.raises(ValueError):
        P.normalize_market(df, "d", "n", on_bad="keep")


def test_infinities_become_null(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("nan"), -float("inf")), (2.0, None)], "a double, b double")
    assert sorted(map(str, P.inf_to_null(df, ["a", "b"]).collect())) == sorted(["Row(a=None, b=1.0)", "Row(a=None, b=None)", "Row(a=2.0, b=None)"])


def test_checks_inside_the_plan(spark):
    df = spark.createDataFrame([("A", START, 1.0), ("A", START, 2.0), ("B", START, 3.0)], "symbol string, date date, close double")
    with pytest.raises(Exception, match="repeated rows"):
        unique(df, ["symbol", "date"]).select("close").collect()
    assert unique(df.filter("close > 1"), ["symbol", "date"]).count() == 2
    with pytest.raises(Exception, match="repeated rows"):
        A.pivot_field(df, "close", ["A", "B"], check="plan").collect()
    assert A.pivot_field(df.filter("close > 1"), "close", ["A", "B"], check="plan").first()["A"] == 2.0
    with pytest.raises(Exception, match="nothing there"):
        some_rows(df, df.filter("close > 9"), "nothing there").count()
    folded = M.assign_folds(df.filter("symbol = 'B'"), ["symbol"], 5, start_date=None)
    with pytest.raises(Exception, match="not enough rows"):
        L.walk_forward(folded.withColumn("target", F.lit(1.0)), ["close"], "target", L.ridge(), key=["symbol"]).collect()
    with pytest.raises(ValueError, match="not enough rows"):
        M.require_folds(folded)


def test_contract_files_without_rows(spark, tmp_path):
    (tmp_path / "JM").mkdir()
    head = "contract,date,open,high,low,close,volume,hold,settle\n"
    (tmp_path / "JM" / "JM2401.csv").write_text(head + "JM2401,bad,1,2,0.5,1.5,10,3,1.4\n")
    with pytest.raises(Exception, match="no contract rows"):
        IO.read_contracts(spark, str(tmp_path / "*" / "*.csv"), lazy=True).collect()


def test_one_source_date(spark):
    rows = [("JM", 5, START, 1.0, 0.5, 1), ("JM", 10, START, 1.0, 0.5, 1)]
    latest = spark.createDataFrame(rows, "product string, horizon int, date date, close double, prediction double, signal int")
    quality = spark.createDataFrame([], "product string, horizon int, forecast string, samples long, avg_realized_return_pct double, direction_accuracy double")
    found = S.latest_signals(latest, quality)
    assert S.one_source_date(found).count() == 2
    with pytest.raises(Exception, match="JM has inconsistent source dates: 2020-01-06, 2020-01-11"):
        S.one_source_date(S.latest_signals(latest.withColumn("date", F.expr("date_add(date, horizon)")), quality)).count()
    calendar = spark.createDataFrame([(START,)], "trade_date date")
    doc = json.loads(S.payload(found, calendar, "2020-01-02", "now").first()["value"])
    assert doc["products"]["JM"]["forecasts"]["10"]["quality"] is None


def test_fold_dates_and_fevd_rows(spark):
    df = spark.createDataFrame([("d", START + dt.timedelta(i)) for i in range(400)], "dataset string, date date")
    dated = M.with_fold_dates(M.assign_folds(df, ["dataset"], 5, start_date=None), ["dataset"])
    row = dated.orderBy("date").first()
    assert (row["train_end_date"], row["test_window_start"]) == (START + dt.timedelta(row["train_end"] - 1), row["date"])
    table = spark.createDataFrame([("a", 10, "b", 1.0), ("a", 20, "b", 2.0)], "target string, horizon_days int, shock string, share_pct double")
    assert [r["share_pct"] for r in V.fevd_at(table).collect()] == [2.0]


def test_ridge_equals_least_squares_on_augmented_rows(spark):
    rng = np.random.default_rng(15)
    n, penalty = 420, 3.0
    x = rng.normal(size=(n, 2)) * [1.0, 50.0]
    y = x @ [1.0, -0.2] + rng.normal(size=n) + 3
    df = spark.createDataFrame([("d", START + dt.timedelta(i), *map(float, x[i]), float(y[i])) for i in range(n)], "dataset string, date date, a double, b double, target double")
    got = L.walk_forward(M.assign_folds(df, ["dataset"], 5, start_date=None), ["a", "b"], "target", L.ridge(penalty)).collect()
    for r in got:
        a, b = x[: r["train_end"]], y[: r["train_end"]]
        mean, scale = a.mean(0), a.std(0)
        rows = np.vstack([(a - mean) / scale, np.sqrt(penalty) * np.eye(2)])
        beta = np.linalg.lstsq(rows, np.append(b - b.mean(), [0, 0]), rcond=None)[0]
        assert r["prediction"] == pytest.approx(b.mean() + beta @ ((np.array([r["a"], r["b"]]) - mean) / scale), rel=1e-8)
    assert len(got) > 100


def test_index_refresh_leaves_other_products_alone(spark, tmp_path):
    from barloom.streaming.refresh import refresh_index

    def bars(close, products, days):
        return [(p, f"{p}2401", START + dt.timedelta(i), 1.0, 2.0, 0.5, close + i, 1.2, 10.0, 3.0 + i % 7) for p in products for i in range(days)]

    schema = "product string, contract string, date date, open double, high double, low double, close double, settle double, volume double, hold double"
    paths = [str(tmp_path / n) for n in ("in", "contracts", "index", "features", "checkpoint")]

    def arrive(rows):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(paths[0])
        refresh_index(spark, *paths, df.schema).awaitTermination()

    files = lambda part: sorted((f, os.path.getmtime(os.path.join(part, f))) for f in os.listdir(part) if f.endswith(".parquet"))
    arrive(bars(100.0, ("A", "B"), 70))
    before = files(f"{paths[2]}/product=B"), files(f"{paths[3]}/dataset=B_weighted")
    arrive(bars(200.0, ("A",), 72))
    assert before == (files(f"{paths[2]}/product=B"), files(f"{paths[3]}/dataset=B_weighted"))
    index, features = spark.read.parquet(paths[2]), spark.read.parquet(paths[3])
    assert index.filter("product = 'A'").agg(F.count("*"), F.max("close")).first()[:] == (72, pytest.approx(271.0))
    assert features.filter("dataset = 'A_weighted'").count() == 12 and features.filter("dataset = 'B_weighted'").count() == 10


@pytest.mark.parametrize("name", ["features_blocks", "metrics_by_horizon", "published_signals", "latest_forecast_pair", "fevd_one_lag", "contract_files", "refresh_index", "compare_datasets"])
def test_new_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    text = lambda rows: sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert text(tuple(r) for r in got.select(*cols).collect()) == text(want)
