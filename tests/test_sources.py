import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from barloom.sources import bars as IO
from barloom.streaming.refresh import refresh_bars


def test_contract_files(spark, tmp_path):
    (tmp_path / "JM").mkdir()
    head = "contract,date,open,high,low,close,volume,hold,settle\n"
    (tmp_path / "JM" / "JM2401.csv").write_text("﻿" + head + "JM2401,2024-01-02,1,2,0.5,1.5,10,x,1.4\nJM2401,bad,1,2,0.5,1.5,10,3,1.4\nJM2401,2024-01-03,1,2,0.5,,10,3,1.4\n", encoding="utf-8")
    (row,) = IO.read_contracts(spark, str(tmp_path / "*" / "*.csv")).collect()
    assert (row["product"], row["contract"], row["date"], row["close"], row["hold"]) == ("JM", "JM2401", dt.date(2024, 1, 2), 1.5, None)
    (seen,) = IO.contract_manifest(IO.read_contracts(spark, str(tmp_path / "*" / "*.csv"))).collect()
    assert (seen["rows"], seen["volume_sum"]) == (1, 10) and seen["path"].endswith("JM2401.csv")
    (tmp_path / "JM" / "JM2401.csv").write_text(head)
    with pytest.raises(ValueError):
        IO.read_contracts(spark, str(tmp_path / "*" / "*.csv"))


def test_read_bars_by_file_name_and_partial_refresh(spark, tmp_path):
    for name, close in (("JM0", 1), ("I0", 2)):
        (tmp_path / f"{name}.csv").write_text(f"date,open,high,low,close,volume,hold,settle\n2024-01-02,1,1,1,{close},5,6,NaN\n")
    registry = spark.createDataFrame([("JM0", "coking-coal")], "symbol string, commodity_slug string")
    out = IO.read_bars(spark, str(tmp_path / "*.csv"), registry)
    assert {(r["symbol"], r["commodity_slug"], r["close"], r["settle"]) for r in out.collect()} == {("JM0", "coking-coal", 1.0, None), ("I0", None, 2.0, None)}
    table = str(tmp_path / "table")
    IO.save_bars(out, table)
    IO.save_bars(out.filter("symbol = 'I0'").withColumn("close", out["close"] + 1), table, partial=True)
    assert {(r["symbol"], r["close"]) for r in spark.read.parquet(table).collect()} == {("JM0", 1.0), ("I0", 3.0)}


def test_refresh_takes_corrections_once(spark, tmp_path):
    from barloom.sources.schemas import BARS

    def arrive(close, symbol="A"):
        row = (symbol, "a", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, close, 1, 1, 1.0)
        spark.createDataFrame([row], BARS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        refresh_bars(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return {(r["symbol"], r["close"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert arrive(1.0) == {("A", 1.0)}
    assert arrive(2.0) == {("A", 2.0)}
    assert arrive(5.0, "B") == {("A", 2.0), ("B", 5.0)}


@pytest.mark.parametrize("name", ["summary", "interval_returns", "weighted_index", "folds", "backtest", "wide_features", "previous_session"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    text = lambda rows: sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert text(tuple(r) for r in got.select(*cols).collect()) == text(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_market_round_trip_keeps_every_series(spark, sf):
    from barloom.plans import registry

    text = lambda df: sorted(map(str, df.collect()))
    got = entry.queries()["market_round_trip"](spark, sf)
    assert got.select("dataset").distinct().count() > 1
    assert text(got) == text(registry._market(spark, sf).select(*got.columns))


def test_tree_queries_take_every_series_and_all_trees(spark, sf, monkeypatch):
    from barloom.operators import learn as L
    from barloom.plans import registry

    seen, small = [], L.gbt(trees=1)
    walk, final = L.walk_forward, L.final_fit

    def whole_walk(df, names, target, learner, **options):
        seen.append((learner, options, df.groupBy("dataset", "fold").count().filter("fold IS NOT NULL").collect()))
        return walk(df.filter("fold IS NULL OR fold = 0"), names, target, small, **options)

    def whole_fit(features, rows, names, learner, **options):
        seen.append((learner, options, rows.select("dataset").distinct().collect()))
        return final(features, rows, names, small, **options)

    monkeypatch.setattr(registry.L, "walk_forward", whole_walk)
    monkeypatch.setattr(registry.L, "final_fit", whole_fit)
    series = {r["dataset"] for r in registry._market(spark, sf).select("dataset").distinct().collect()}
    for name in ("walk_forward_trees", "importance_trees", "latest_forecast_trees"):
        assert {r["dataset"] for r in entry.queries()[name](spark, sf).select("dataset").collect()} == series
        learner, options, rows = seen.pop()
        assert learner == L.gbt() and learner.trees == 250 and not options and {r["dataset"] for r in rows} == series
        assert all(r["count"] <= 63 for r in rows if name == "walk_forward_trees")
