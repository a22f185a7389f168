import datetime as dt
import math
import random

import pytest

from barloom.operators import index as I

DAY = dt.date(2024, 1, 1)
SCHEMA = "product string, contract string, date date, open double, high double, low double, close double, settle double, volume double, hold double"


def bar(contract, day, close, volume=10.0, hold=1.0, product="JM"):
    c = close if close is not None else None
    up = None if c is None else c + 1
    return (product, contract, DAY + dt.timedelta(day), c, up, None if c is None else c - 1, c, c, volume, hold)


def rows(df):
    return [r.asDict() for r in df.orderBy("date").collect()]


def test_oi_weighted_return_uses_previous_day(spark):
    data = [bar("JM2401", 0, 100.0, hold=3.0), bar("JM2401", 1, 110.0, hold=3.0), bar("JM2405", 0, 200.0), bar("JM2405", 1, 210.0)]
    random.Random(1).shuffle(data)
    out = I.build_index(spark.createDataFrame(data, SCHEMA))
    assert len(out.columns) == 33
    first, second = rows(out)
    want = (3 * math.log(1.1) + math.log(210 / 200)) / 4 * 100
    assert second["oi_weighted_return_pct"] == pytest.approx(want)
    assert second["close"] == pytest.approx(first["close"] * math.exp(want / 100))
    assert (first["dominant_contract_changed"], second["dominant_contract_changed"]) == (0, 0)


def test_ranks_ties_and_missing_weights(spark):
    data = [bar("B", 0, 10.0, volume=5.0), bar("A", 0, 11.0, volume=5.0), bar("A", 1, 11.0, volume=2.0), bar("A", 2, 12.0, volume=0.0), bar("B", 3, 12.0, volume=None)]
    out = rows(I.rank_features(spark.createDataFrame(data, SCHEMA), "volume", "volume"))
    assert [r["dominant_volume_contract"] for r in out] == ["A", "A", None, None]
    assert [r["volume_roll_pressure"] for r in out] == [1.0, 0.0, None, None]
    assert [r["second_volume_share"] for r in out] == [0.5, 0.0, None, None]


def test_dominant_changed_between_nulls(spark):
    df = spark.createDataFrame([("JM", DAY + dt.timedelta(i), c) for i, c in enumerate([None, None, "A", "A", "B", None])], "product string, date date, c string")
    got = lambda **k: [r["x"] for r in rows(df.withColumn("x", I.dominant_changed("c", **k)))]
    assert got() == [0, 0, 1, 0, 1, 1]
    assert got(null_is_change=True) == [0, 1, 1, 0, 1, 1]


def test_return_index_follows_recursion(spark):
    rng = random.Random(7)
    data, want, level = [], [], None
    for i in range(300):
        ref = None if rng.random() < 0.3 or i < 3 else rng.uniform(50, 150)
        ret = None if rng.random() < 0.3 else rng.gauss(0, 2)
        if level is None:
            level = ref
        elif ret is not None:
            level *= math.exp(ret / 100)
        elif ref is not None:
            level = ref
        data.append(("JM", DAY + dt.timedelta(i), ref, ret))
        want.append(level)
    df = spark.createDataFrame(data, "product string, date date, ref double, ret double").repartition(3)
    got = [r["return_index_close"] for r in rows(I.return_index(df, "product", "ref", "ret"))]
    assert got == [w if w is None else pytest.approx(w) for w in want]
    assert want[:3] == [None] * 3


def test_zero_volume_day_keeps_close(spark):
    data = [bar("A", 0, 100.0), bar("A", 1, 101.0, volume=0.0)]
    last = rows(I.build_index(spark.createDataFrame(data, SCHEMA)))[1]
    assert last["close"] == pytest.approx(101.0) and last["open"] is None and last["settle"] is None


def test_no_contracts(spark):
    assert I.build_index(spark.createDataFrame([], SCHEMA)).count() == 0
