"""The registered panel queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.operators import backtest as B
from barloom.operators import bars as Q
from barloom.operators import calendar as K
from barloom.operators import clean as P
from barloom.operators import features as X
from barloom.operators import folds as M
from barloom.operators import index as I
from barloom.operators import learn as L
from barloom.operators import panel as A
from barloom.operators import signals as S
from barloom.operators import var as V
from barloom.plans import sql as D
from barloom.sources import adapters
from barloom.sources import bars as IO
from barloom.sources.adapters import read_table
from barloom.sources.schemas import BARS, MEASURES
from barloom.sources.scratch import scratch_path, settled
from barloom.streaming.refresh import refresh_bars as stream_refresh
from barloom.streaming.refresh import refresh_index as stream_index

FLAGSHIP = "weighted_index"
SYMBOLS = D.SYMBOLS
DAY = "2001-06-15"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it has any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def six(c: str | Column) -> Column:
    """Rounded to 6 digits as the SQL does: the product is rounded, not the decimal text, and halves go up."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x * 1e6 + 0.003, 0) / 1e6 + F.lit(0.0)


def seven(df: DataFrame, *names: str) -> DataFrame:
    """Seven significant digits."""
    return df.withColumns({n: F.when(F.col(n).isNotNull(), F.format_string("%.6e", F.col(n) * 1.0000000003).cast("double")) for n in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: six(n) for n in names})


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem")


def _main(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.main_bars(_lines(spark, sf)).withColumn("commodity_slug", F.lower("symbol"))


def _contracts(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.contract_bars(_lines(spark, sf))


def _market(spark: SparkSession, sf: str) -> DataFrame:
    rows = _main(spark, sf).drop("commodity_slug").withColumn("dataset", F.col("symbol")).drop("symbol")
    return P.normalize_market(rows.withColumn("ordinal", F.lit(0)), None, "ordinal")


def _weighted_market(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.build_index(_contracts(spark, sf)).withColumn("dataset", F.concat("product", F.lit("_weighted"))).drop("product")
    return P.normalize_market(rows.withColumn("ordinal", F.lit(0)), None, "ordinal")


def _both_markets(spark: SparkSession, sf: str) -> DataFrame:
    """Main and weighted series as one frame, written once; columns that only weighted ones have are NULL for the others.

    The reader fills these in: a plan with a literal NULL for each takes the optimizer minutes.
    """
    main, weighted, where = _market(spark, sf), _weighted_market(spark, sf), scratch_path(spark, "markets")
    for part in (main, weighted):
        part.write.mode("append").parquet(where)
    return spark.read.schema(weighted.schema).parquet(where)


# --- bar tables and canned questions

SLUGGED = f"WITH {D.MAIN} SELECT symbol, commodity_slug, "


@query(SLUGGED + "count(*) AS rows, min(date) AS start_date, max(date) AS end_date, round(min(close), 2) AS min_close, round(max(close), 2) AS max_close FROM main GROUP BY ALL")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.summary(_main(spark, sf))


@query(SLUGGED + "date, close, settle, volume, hold FROM main QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return Q.latest(_main(spark, sf)).select("symbol", "commodity_slug", "date", "close", "settle", "volume", "hold")


_INTERVAL = "min(date) AS start_date, arg_min(close, date) AS start_close, max(date) AS end_date, arg_max(close, date) AS end_close, round((arg_max(close, date) / nullif(arg_min(close, date), 0) - 1) * 100, 2) AS return_pct FROM main"


@query(SLUGGED + _INTERVAL + " GROUP BY ALL")
def interval_returns(spark: SparkSession, sf: str) -> DataFrame:
    return Q.interval_returns(_main(spark, sf))


@query(SLUGGED + _INTERVAL + " WHERE date >= DATE '1996-01-01' AND date <= DATE '1998-12-31' GROUP BY ALL")
def interval_returns_bounded(spark: SparkSession, sf: str) -> DataFrame:
    return Q.interval_returns(_main(spark, sf), start="1996-01-01", end="1998-12-31")


@query(SLUGGED + "min(date) AS start_date, max(date) AS end_date, count(*) AS row_count FROM main GROUP BY ALL")
def bar_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return IO.bar_metadata(_main(spark, sf))


@query(f"WITH {D.MAIN} SELECT symbol, date, close, volume FROM main WHERE symbol IN ('A', 'R') AND date >= DATE '1997-01-01'")
def symbols_and_dates(spark: SparkSession, sf: str) -> DataFrame:
    return P.date_range(P.only_symbols(_main(spark, sf), ["A", "R"], ["symbol", "date", "close", "volume"]), start="1997-01-01")


@query(
    f"WITH {D.LINES} SELECT l_returnflag AS dataset, date, arg_max(px, k) AS open, arg_max(px, k) AS high, arg_max(px, k) AS low, arg_max(px, k) AS close, arg_max(px, k) AS settle, arg_max(l_quantity, k) AS volume, arg_max(l_extendedprice, k) AS open_interest FROM li GROUP BY l_returnflag, date"
)
def normalize_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every line is a version of its day's bar, given as text; the last line stays."""
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("string")
    rows = _lines(spark, sf).select(
        F.col("l_returnflag").alias("dataset"),
        F.to_date("l_shipdate").cast("string").alias("date"),
        *[price.alias(c) for c in ("open", "high", "low", "close", "settle")],
        F.col("l_quantity").cast("string").alias("volume"),
        F.col("l_extendedprice").cast("string").alias("hold"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("ordinal"),
    )
    return P.normalize_market(rows, None, "ordinal")


_BARS_SQL = "open, high, low, close, CAST(volume AS BIGINT) AS volume, CAST(floor(hold) AS BIGINT) AS hold, settle"


@query(f"WITH {D.MAIN} SELECT symbol, commodity_slug, date, {_BARS_SQL} FROM main")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written as one folder of CSV files per symbol, read back as the long table, saved and read again."""
    rows = _main(spark, sf)
    where = scratch_path(spark, "csv")
    rows.select("symbol", "date", *MEASURES).write.option("header", True).partitionBy("symbol").csv(where)
    key = F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1)
    registry = rows.select("symbol", "commodity_slug").distinct()
    read = IO.read_bars(spark, f"{where}/*/*.csv", registry, key_from_path=key)
    table = scratch_path(spark, "bars")
    IO.save_bars(read, table)
    return spark.read.schema(BARS).parquet(table).select(*BARS.names)


@query(f"WITH {D.MAIN_MARKET} SELECT * FROM market")
def market_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All main series written as one CSV result, partitioned by dataset, and read back as market frames in one scan."""
    where = scratch_path(spark, "market") + ".csv"
    IO.write_result(_market(spark, sf), where, form="csv")
    return IO.read_market(spark, where).select("dataset", "date", "open", "high", "low", "close", "volume", "settle", "open_interest")


@query(
    f"WITH {D.CONTRACTS} SELECT contract, count(*) AS rows, min(date) AS start_date, max(date) AS end_date, CAST(sum(volume) AS BIGINT) AS volume_sum FROM contracts GROUP BY contract"
)
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return IO.contract_manifest(_contracts(spark, sf))


_FILE_ROWS = f"{D.CONTRACTS}, filed AS (SELECT product, contract, date, open, CASE WHEN day(date) <> 29 THEN high END AS high, low, close, CASE WHEN day(date) <> 13 THEN volume END AS volume, hold, settle FROM contracts WHERE day(date) < 30)"


def _contract_files(spark: SparkSession, sf: str) -> DataFrame:
    """Contract bars written as CSV files in a folder for each product, some values spoilt, and read back.

    Of a month's days the 31st has no date, the 30th no close, the 29th an infinite
    high and the 13th a volume that is no number.
    """
    day, where = F.dayofmonth("date"), scratch_path(spark, "contracts")
    rows = _contracts(spark, sf).select(
        F.col("product").alias("folder"),
        "contract",
        F.when(day == 31, "no date").otherwise(F.col("date").cast("string")).alias("date"),
        "open",
        F.when(day == 29, "Infinity").otherwise(F.col("high").cast("string")).alias("high"),
        "low",
        F.when(day != 30, F.col("close")).alias("close"),
        F.when(day == 13, "many").otherwise(F.col("volume").cast("string")).alias("volume"),
        "hold",
        "settle",
    )
    rows.write.option("header", True).partitionBy("folder").csv(where)
    read = IO.read_contracts(spark, f"{where}/*/*.csv", lazy=True)
    return read.withColumn("product", F.regexp_replace("product", "^folder=", ""))


@query(f"WITH {_FILE_ROWS} SELECT product, contract, date, {', '.join(MEASURES)} FROM filed")
def contract_files(spark: SparkSession, sf: str) -> DataFrame:
    return _contract_files(spark, sf).drop("path")


@query(f"WITH {_FILE_ROWS} SELECT contract, count(*) AS rows, min(date) AS start_date, max(date) AS end_date, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume_sum, 'csv' AS path_ending FROM filed GROUP BY contract")
def contract_files_manifest(spark: SparkSession, sf: str) -> DataFrame:
    out = IO.contract_manifest(_contract_files(spark, sf))
    return out.withColumn("path_ending", F.substring_index("path", ".", -1)).drop("path")


# --- contract calendars and sessions


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("l_shipdate")
    return _lines(spark, sf).groupBy(F.col("l_returnflag").alias("code")).agg(F.min(year).alias("start_year"), F.max(year).alias("end_year"))


# Two digits of a year stand for 2000 and later, so that earlier years' contracts have later periods.
_CALENDAR = (
    "codes AS (SELECT l_returnflag AS product, unnest(range(min(year(l_shipdate)), max(year(l_shipdate)) + 1)) AS y FROM lineitem GROUP BY l_returnflag), months AS (SELECT product, y, m, product || lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') AS contract, make_date(2000 + y % 100, m, 1) AS period"
    " FROM codes, range(1, 13) b(m)), window_ AS (SELECT product, contract, period, (2001 - year(period)) * 12 + 6 - month(period) > 2 AS settled FROM months WHERE (year(period) - 2001) * 12 + month(period) - 6 <= 15)"
)


def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    return K.in_listing_window(K.contract_symbols(_registry(spark, sf), F.col("start_year"), F.col("end_year")), DAY)


@query(f"WITH {_CALENDAR} SELECT * FROM window_")
def contract_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_settled(_calendar(spark, sf), DAY)


_CACHED = "cache AS (SELECT l_returnflag || lpad(CAST(year(l_shipdate) % 100 AS VARCHAR), 2, '0') || lpad(CAST(month(l_shipdate) AS VARCHAR), 2, '0') AS contract, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1)"


@query(
    f"WITH {_CALENDAR}, {_CACHED} SELECT product, w.contract, period, settled, n IS NOT NULL AS cached, NOT (settled AND n IS NOT NULL AND coalesce(n, 0) > 0) AS refetch FROM window_ w LEFT JOIN cache c USING (contract)"
)
def refresh_plan(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("l_returnflag", F.date_format("l_shipdate", "yyMM"))
    cached = _lines(spark, sf).groupBy(name.alias("contract")).agg(F.count("*").alias("rows"))
    return K.refresh_plan(_calendar(spark, sf), cached, DAY)


@query(
    "WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + 3 AS date FROM orders)"
    " SELECT q.date, EXISTS (SELECT 1 FROM s WHERE s.d = q.date) AS is_trading_day, s.d AS previous_session FROM q ASOF JOIN s ON q.date > s.d"
)
def previous_session(spark: SparkSession, sf: str) -> DataFrame:
    days = read_table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    return K.previous_session(days.select(F.date_add("d", 3).alias("date")), days.select(F.col("d").alias("trade_date")))


# --- weighted index

_RETURN_COLUMNS = "product, contract, date, close, volume, hold, prev_close, prev_volume, prev_hold"


@query(f"WITH {D.RETURNS_CTE} SELECT {_RETURN_COLUMNS}, {D.R('contract_return_pct')} AS contract_return_pct FROM returns")
def contract_returns(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(I.contract_returns(_contracts(spark, sf)), "contract_return_pct")
    return out.select(*_RETURN_COLUMNS.split(", "), "contract_return_pct")


_TOTAL_NAMES = list(D.TOTALS)
_SHARES = [n for n in D.RANKS if not n.endswith("contract")]


def _large(name: str) -> bool:
    """Whether a column depends on the index level, which may have any size."""
    return name in (*I.PRICES, "return_index_close", "oi_volume_weighted_close_gap_pct")


def _sql_rounded(names: list[str], plain: tuple[str, ...] = ()) -> str:
    return ", ".join(n if n in plain else f"{(D.S if _large(n) else D.R)(n)} AS {n}" for n in names)


def both_rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return seven(rounded(df, *[n for n in names if not _large(n)]), *[n for n in names if _large(n)])


_COUNTS = ("active_contracts", "volume", "open_interest")


@query(f"WITH {D.DAYS} SELECT product, date, {_sql_rounded(_TOTAL_NAMES, _COUNTS)} FROM days")
def daily_weighted(spark: SparkSession, sf: str) -> DataFrame:
    out = I.daily_totals(I.contract_returns(_contracts(spark, sf)))
    return both_rounded(out, [n for n in _TOTAL_NAMES if n not in _COUNTS])


@query(f"WITH {D.DAYS} SELECT product, date, dominant_oi_contract, {_sql_rounded([n for n in _SHARES if 'oi' in n])} FROM days")
def rank_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.rank_features(_contracts(spark, sf), "hold", "oi"), *[n for n in _SHARES if "oi" in n])


@query(f"WITH {D.INDEX} SELECT product, date, dominant_volume_contract, dominant_volume_contract_changed FROM idx")
def dominant_changed(spark: SparkSession, sf: str) -> DataFrame:
    out = I.rank_features(_contracts(spark, sf), "volume", "volume")
    return out.select("product", "date", "dominant_volume_contract", I.dominant_changed("dominant_volume_contract").alias("dominant_volume_contract_changed"))


@query(f"WITH {D.INDEX} SELECT product, date, {D.S('return_index_close')} AS return_index_close FROM idx")
def return_index(spark: SparkSession, sf: str) -> DataFrame:
    days = I.daily_totals(I.contract_returns(_contracts(spark, sf)))
    out = I.return_index(days, "product", "oi_weighted_close", "oi_weighted_return_pct")
    return seven(out.select("product", "date", "return_index_close"), "return_index_close")


_INDEX_NAMES = [*D.TOTALS, *D.RANKS, *D.CHANGED, "return_index_close", "open", "high", "low", "close", "settle"]
_INDEX_PLAIN = (*_COUNTS, *D.CHANGED, *[n for n in D.RANKS if n.endswith("contract")])


@query(f"WITH {D.INDEX} SELECT product, date, {_sql_rounded(_INDEX_NAMES, _INDEX_PLAIN)} FROM idx")
def weighted_index(spark: SparkSession, sf: str) -> DataFrame:
    return both_rounded(I.build_index(_contracts(spark, sf)), [n for n in _INDEX_NAMES if n not in _INDEX_PLAIN])


@query(ORACLES["weighted_index"])
def weighted_index_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The index with levels carried from span to span, and changes by blocks of 256 rows."""
    return both_rounded(I.build_index(_contracts(spark, sf), block_rows=256), [n for n in _INDEX_NAMES if n not in _INDEX_PLAIN])


# --- features and labels

_MAIN5, _NAMES = D.features(D.MAIN_MARKET, 5)
_MAIN10, _ = D.features(D.MAIN_MARKET, 10)
_WEIGHTED5, _WNAMES = D.features(D.INDEX_MARKET, 5, weighted=True)


@query(f"WITH {_MAIN5} SELECT dataset, date, close, {_sql_rounded(['daily_return_pct', *_NAMES])} FROM feats")
def features_main(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, names = X.add_features(_market(spark, sf), horizon=5)
    return rounded(rows.select("dataset", "date", "close", "daily_return_pct", *names), "daily_return_pct", *names)


@query(f"WITH {_WEIGHTED5} SELECT dataset, date, {_sql_rounded(_WNAMES)} FROM feats")
def features_weighted(spark: SparkSession, sf: str) -> DataFrame:
    rows, _, names = X.add_features(_weighted_market(spark, sf), horizon=5)
    return both_rounded(rows.select("dataset", "date", *names), names)


def _labels(spark: SparkSession, sf: str, h: int) -> DataFrame:
    rows, _, _ = X.add_features(_market(spark, sf), horizon=h)
    return rounded(rows.select("dataset", "date", X.target_column(h), X.direction_column(h)), X.target_column(h))


@query(f"WITH {_MAIN5} SELECT dataset, date, {D.R('target')} AS future_5d_return_pct, up AS future_5d_up FROM feats")
def labels_h5(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf, 5)


@query(f"WITH {_MAIN10} SELECT dataset, date, {D.R('target')} AS future_10d_return_pct, up AS future_10d_up FROM feats")
def labels_h10(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf, 10)


@query(
    "WITH h AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS date, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2), r AS (SELECT *, "
    + D.ln_pct("close", D.lag("close", 1, "symbol"))
    + f" AS ret FROM h) SELECT symbol, strftime(date, '%Y-%m-%d %H') AS hour, close, volume, {D.R('ret')} AS ret, {D.R(D.full('stddev_samp', 'ret', 20, 'symbol'))} AS vol20 FROM r"
)
def hourly_returns(spark: SparkSession, sf: str) -> DataFrame:
    from barloom.functions import columns as C

    w = W.partitionBy("symbol").orderBy("date")
    rows = adapters.hourly_bars(read_table(spark, sf, "events")).withColumn("ret", C.log_return("close", 1, w))
    rows = rows.withColumn("vol20", C.rolling_vol("ret", 20, w))
    return rounded(rows.select("symbol", F.date_format("date", "yyyy-MM-dd HH").alias("hour"), "close", "volume", "ret", "vol20"), "ret", "vol20")


@query(f"WITH {_MAIN5} SELECT dataset, date, close, {_sql_rounded(['daily_return_pct', *_NAMES])} FROM feats")
def features_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The features of blocks of 256 rows: many tasks a series, the same values."""
    rows, _, names = X.add_features(_market(spark, sf), horizon=5, block_rows=256)
    return rounded(rows.select("dataset", "date", "close", "daily_return_pct", *names), "daily_return_pct", *names)


HORIZONS = (5, 10)
_TARGETS = "SELECT dataset, date, {0} AS horizon, {1} AS target, up FROM feats WHERE target IS NOT NULL"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {cte} {_TARGETS.format(h, D.R('target'))})" for h, cte in zip(HORIZONS, (_MAIN5, _MAIN10), strict=True)))
def labels_by_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """All horizons from one window pass, as a key."""
    rows = X.add_horizons(_market(spark, sf), horizons=HORIZONS, block_rows=512)[1]
    return rounded(rows.select("dataset", "date", "horizon", "target", "up"), "target")


# --- folds


def _model_rows(spark: SparkSession, sf: str, horizon: int = 5, weighted: bool = False) -> tuple[DataFrame, list[str]]:
    market = _weighted_market(spark, sf) if weighted else _market(spark, sf)
    _, rows, names = X.add_features(market, horizon=horizon)
    return settled(X.labelled(rows, horizon), "model-rows"), names


def _folds(spark: SparkSession, sf: str, **options: object) -> DataFrame:
    rows, _ = _model_rows(spark, sf)
    return M.fold_table(M.assign_folds(rows, ["dataset"], 5, **options), ["dataset"]).drop("_")


_FOLDS = (
    " SELECT dataset, f.fold, f.train_end, test_window_start, test_window_end, test_rows, p.date AS train_end_date FROM"
    " (SELECT dataset, fold, min(train_end) AS train_end, min(date) AS test_window_start, max(date) AS test_window_end, count(*) AS test_rows FROM folded WHERE fold IS NOT NULL GROUP BY dataset, fold) f"
    " LEFT JOIN folded p USING (dataset) WHERE p.position + 1 = f.train_end"
)


@query(f"WITH {D.folds(_MAIN5, 5)}{_FOLDS}")
def folds(spark: SparkSession, sf: str) -> DataFrame:
    return _folds(spark, sf, start_date=None)


@query(f"WITH {D.folds(_MAIN5, 5, start_date='1999-01-04')}{_FOLDS}")
def folds_dated(spark: SparkSession, sf: str) -> DataFrame:
    return _folds(spark, sf, start_date="1999-01-04")


@query(f"WITH {D.folds(_MAIN5, 5, min_train=0, purge=0)}{_FOLDS}")
def folds_unpurged(spark: SparkSession, sf: str) -> DataFrame:
    return _folds(spark, sf, start_date=None, min_train=0, purge=0)


@query(f"WITH {D.folds(_MAIN5, 5)}, ends AS (SELECT DISTINCT dataset, fold, train_end FROM folded WHERE fold IS NOT NULL) SELECT dataset, e.fold, count(*) FILTER (WHERE p.position < e.train_end) AS train_rows, count(*) FILTER (WHERE p.fold = e.fold) AS test_rows FROM ends e JOIN folded p USING (dataset) GROUP BY dataset, e.fold")
def train_test_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _model_rows(spark, sf)
    table = M.fold_table(M.assign_folds(rows, ["dataset"], 5, start_date=None), ["dataset"])
    return table.select("dataset", "fold", F.col("train_end").cast("long").alias("train_rows"), "test_rows")


# --- backtests, with the last five days' return as the prediction


def _predictions(spark: SparkSession, sf: str, weighted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, model rows, and the feature rows' last day scored."""
    market = _weighted_market(spark, sf) if weighted else _market(spark, sf)
    features = settled(X.add_features(market, horizon=5)[0], "features")
    rows = M.assign_folds(X.labelled(features.dropna(subset=[X.target_column(5)]), 5), ["dataset"], 5, start_date=None)
    pred = rows.filter("fold IS NOT NULL").withColumn("prediction", F.col("return_5d_pct"))
    last = Q.latest(features, ["dataset"]).withColumn("prediction", F.col("return_5d_pct")).withColumn("horizon", F.lit(5))
    live = last.select("dataset", "horizon", "date", "close", "prediction", F.when(F.col("prediction") > 0, 1).otherwise(-1).alias("signal"))
    return pred, rows, live


_BT = D.backtest(D.folds(_MAIN5, 5))
_WBT = D.backtest(D.folds(_WEIGHTED5, 5))
_BT_NAMES = ["prediction", "target", "strategy_daily_return_pct", "strategy_equity", "buy_hold_equity"]


@query(f"WITH {_BT} SELECT dataset, date, fold, signal, position_ AS position, turnover, {D.R('prediction')} AS prediction, {D.R('target')} AS target, {D.R('strategy')} AS strategy_daily_return_pct, {D.R('strategy_equity')} AS strategy_equity, {D.R('buy_hold_equity')} AS buy_hold_equity FROM bt")
def backtest(spark: SparkSession, sf: str) -> DataFrame:
    pred, _, _ = _predictions(spark, sf)
    return rounded(B.backtest(pred).select("dataset", "date", "fold", "signal", "position", "turnover", *_BT_NAMES), *_BT_NAMES)


_METRICS = ["mae", "rmse", "r2", "directional_accuracy", "strategy_total_return_pct", "buy_hold_total_return_pct", "strategy_annual_return_pct", "strategy_annual_vol_pct", "strategy_sharpe", "max_drawdown_pct"]


@query(ORACLES["backtest"])
def backtest_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Positions by blocks of 256 rows, equities carried from span to span."""
    pred, _, _ = _predictions(spark, sf)
    return rounded(B.backtest(pred, block_rows=256).select("dataset", "date", "fold", "signal", "position", "turnover", *_BT_NAMES), *_BT_NAMES)


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    pred, rows, _ = _predictions(spark, sf)
    return rounded(B.metrics(B.backtest(pred), model_rows=rows), *_METRICS).drop("horizon")


@query(f"WITH {D.metrics(_BT)} SELECT * FROM scored JOIN known USING (dataset)")
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@query(f"SELECT * FROM (WITH {D.metrics(_BT)} SELECT * FROM scored JOIN known USING (dataset)) UNION ALL SELECT * FROM (WITH {D.metrics(_WBT)} SELECT * FROM scored JOIN known USING (dataset))")
def compare_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Main and weighted series side by side: one market frame, one plan."""
    features = X.add_features(_both_markets(spark, sf), horizon=5, has_weighted=F.endswith(F.col("dataset"), F.lit("_weighted")))[1]
    features = settled(features, "features")
    rows = settled(M.assign_folds(X.labelled(features, 5), ["dataset"], 5, start_date=None), "model-rows")
    pred = rows.filter("fold IS NOT NULL").withColumn("prediction", F.col("return_5d_pct"))
    return rounded(B.metrics(B.backtest(pred), model_rows=rows), *_METRICS).drop("horizon")


@query(ORACLES["metrics"])
def metrics_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of backtest_blocks, the highest equity so far carried from span to span."""
    pred, rows, _ = _predictions(spark, sf)
    return rounded(B.metrics(B.backtest(pred, block_rows=256), model_rows=rows, long=True), *_METRICS).drop("horizon")


def _by_horizon(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Feature rows, and model rows of all horizons with their folds."""
    features, rows, names = X.add_horizons(_market(spark, sf), horizons=HORIZONS)
    features = settled(features, "features")
    rows = features.withColumn("_of", F.explode("targets")).drop("targets").withColumns({"horizon": F.col("_of.horizon"), "target": F.col("_of.target")}).drop("_of")
    return features, M.assign_folds(rows.filter("target IS NOT NULL"), B.KEY, "horizon", start_date=None), names


_BT10 = D.backtest(D.folds(_MAIN10, 10))


@query(" UNION ALL ".join(f"SELECT {h} AS horizon, * FROM (WITH {D.metrics(bt)} SELECT * FROM scored JOIN known USING (dataset))" for h, bt in zip(HORIZONS, (_BT, _BT10), strict=True)))
def metrics_by_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """Both horizons backtested in one plan."""
    _, rows, _ = _by_horizon(spark, sf)
    rows = settled(rows, "model-rows")
    pred = rows.filter("fold IS NOT NULL").withColumn("prediction", F.col("return_5d_pct"))
    return rounded(B.metrics(B.backtest(pred), model_rows=rows), *_METRICS)


_QUALITY = ["avg_predicted_return_pct", "avg_realized_return_pct", "median_realized_return_pct", "direction_accuracy", "sample_share"]


@query(f"WITH {D.quality(_BT)} SELECT * FROM quality")
def forecast_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.forecast_quality(_predictions(spark, sf)[0]), *_QUALITY).drop("horizon")


_LIVE = "live AS (SELECT dataset, date, close, return_5d_pct AS prediction, CASE WHEN return_5d_pct > 0 THEN 1 ELSE -1 END AS signal FROM feats QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY date DESC) = 1)"


@query(
    f"WITH {_BT}, {_LIVE}, last AS (SELECT * FROM bt QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY date DESC) = 1)"
    f" SELECT dataset, l.date AS live_date, l.close AS live_close, {D.R('l.prediction')} AS live_prediction, l.signal AS live_signal, v.date AS verified_date, {D.R('v.prediction')} AS verified_prediction, {D.R('v.target')} AS verified_target, v.signal AS verified_signal FROM live l LEFT JOIN last v USING (dataset)"
)
def latest_vs_verified(spark: SparkSession, sf: str) -> DataFrame:
    pred, _, live = _predictions(spark, sf)
    out = B.latest_vs_verified(live, B.backtest(pred)).drop("horizon")
    return rounded(out, "live_prediction", "verified_prediction", "verified_target")


@query(
    f"WITH {D.quality(_BT)}, {_LIVE} SELECT dataset AS product, 5 AS horizon, strftime(date, '%Y-%m-%d') AS source_date, close, {D.R('prediction')} AS predicted_return_pct, signal, CASE WHEN signal > 0 THEN 'bullish' ELSE 'bearish' END AS direction, samples, avg_realized_return_pct, direction_accuracy"
    " FROM live l LEFT JOIN (SELECT dataset AS d, forecast, samples, avg_realized_return_pct, direction_accuracy FROM quality) q ON l.dataset = q.d AND q.forecast = CASE WHEN signal > 0 THEN 'bullish' ELSE 'bearish' END"
)
def signals(spark: SparkSession, sf: str) -> DataFrame:
    pred, _, live = _predictions(spark, sf)
    quality = rounded(B.forecast_quality(pred), *_QUALITY).withColumnRenamed("dataset", "product")
    out = S.latest_signals(rounded(live.withColumnRenamed("dataset", "product"), "prediction"), quality)
    return out.select("product", "horizon", F.date_format("date", "yyyy-MM-dd").alias("source_date"), "close", "forecast.predicted_return_pct", "forecast.signal", "forecast.direction", "forecast.quality.*")


@query()
def signals_document(spark: SparkSession, sf: str) -> DataFrame:
    """The published JSON document of both horizons, written as text and read back."""
    return spark.read.text(_published(spark, sf))


def _published(spark: SparkSession, sf: str) -> str:
    """Where the document of all products and horizons is, which come from one plan."""
    features, rows, _ = _by_horizon(spark, sf)
    pred = M.tested(rows).withColumn("prediction", F.col("return_5d_pct")).withColumnRenamed("dataset", "product")
    quality = B.forecast_quality(settled(pred.select("product", "horizon", "target", "prediction"), "predictions"), ("product", "horizon"))
    last = Q.latest(features, ["dataset"]).withColumn("prediction", F.col("return_5d_pct"))
    signal = F.when(F.col("prediction") > 0, 1).otherwise(-1).alias("signal")
    live = last.select(F.col("dataset").alias("product"), F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon"), "date", "close", "prediction", signal)
    found = S.one_source_date(S.latest_signals(live, quality))
    calendar = read_table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("trade_date"))
    where = scratch_path(spark, "signals")
    IO.write_document(S.payload(found, calendar, "2002-01-01", "2002-01-01T00:00:00+09:00"), where)
    return where


_FORECAST = "struct<predicted_return_pct: double, signal: int, direction: string, quality: struct<samples: bigint, avg_realized_return_pct: double, direction_accuracy: double>>"
_DOCUMENT = f"schema_version int, generated_at string, report_date string, is_trading_day boolean, expected_source_date string, products map<string, struct<source_date: string, close: double, forecasts: map<string, {_FORECAST}>>>"


def _published_sql(h: int, bt: str) -> str:
    return (
        f"SELECT * FROM (WITH {D.quality(bt)}, {_LIVE}, day AS (SELECT max(CAST(o_orderdate AS DATE)) AS session, EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '2002-01-01') AS open FROM orders WHERE o_orderdate < DATE '2002-01-01')"
        f" SELECT 1 AS schema_version, '2002-01-01' AS report_date, open AS is_trading_day, strftime(session, '%Y-%m-%d') AS expected_source_date, dataset AS product, strftime(date, '%Y-%m-%d') AS source_date, close, {h} AS horizon, {D.R('prediction')} AS predicted_return_pct, signal, CASE WHEN signal > 0 THEN 'bullish' ELSE 'bearish' END AS direction, samples, avg_realized_return_pct, direction_accuracy"
        " FROM live l CROSS JOIN day LEFT JOIN (SELECT dataset AS d, forecast, samples, avg_realized_return_pct, direction_accuracy FROM quality) q ON l.dataset = q.d AND q.forecast = CASE WHEN signal > 0 THEN 'bullish' ELSE 'bearish' END)"
    )


@query(" UNION ALL ".join(map(_published_sql, HORIZONS, (_BT, _BT10))))
def published_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The written document, parsed: a row for each product and horizon."""
    doc = spark.read.text(_published(spark, sf)).select(F.from_json("value", _DOCUMENT).alias("doc")).select("doc.*")
    rows = doc.select("schema_version", "report_date", "is_trading_day", "expected_source_date", F.explode("products").alias("product", "of"))
    rows = rows.select("*", "of.source_date", "of.close", F.explode("of.forecasts").alias("horizon", "forecast")).drop("of")
    out = rows.select(*[c for c in rows.columns if c not in ("horizon", "forecast")], F.col("horizon").cast("int").alias("horizon"), "forecast.*")
    out = out.select("*", "quality.*").drop("quality")
    return rounded(out, "predicted_return_pct", "avg_realized_return_pct", "direction_accuracy")


# --- learners


@query()
def walk_forward_ridge(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _model_rows(spark, sf)
    out = L.walk_forward(M.assign_folds(rows, ["dataset"], 5, start_date=None), names, "target", L.ridge())
    out = M.with_fold_dates(out, ["dataset"])
    return rounded(out.select("dataset", "date", "fold", "train_end_date", "test_window_start", "test_window_end", "target", "prediction"), "target", "prediction")


@query()
def walk_forward_ridge_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The ridge forecasts of both horizons, backtested."""
    _, rows, names = _by_horizon(spark, sf)
    pred = settled(L.walk_forward(settled(rows, "model-rows"), names, "target", L.ridge(), B.KEY), "predictions")
    return rounded(B.metrics(B.backtest(pred)), *_METRICS)


_PAIR = ("return_5d_pct", "volatility_20d_pct")
_PAIR_FOLDS = "SELECT e.dataset, e.fold, p.* EXCLUDE (dataset, fold) FROM (SELECT DISTINCT dataset, fold, train_end FROM folded WHERE fold IS NOT NULL) e JOIN folded p ON p.dataset = e.dataset AND p.position < e.train_end"


@query(f"WITH {D.ridge_pair(D.folds(_MAIN5, 5), *_PAIR, 2.0, _PAIR_FOLDS)} SELECT f.dataset, f.date, f.fold, {D.R('f.target')} AS target, {D.R('k + b1 * f.return_5d_pct + b2 * f.volatility_20d_pct')} AS prediction FROM folded f JOIN fit ON fit.dataset = f.dataset AND fit.fold = f.fold")
def walk_forward_ridge_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge of two features on every fold, which SQL can solve."""
    rows, _ = _model_rows(spark, sf)
    out = L.walk_forward(M.assign_folds(rows, ["dataset"], 5, start_date=None), _PAIR, "target", L.ridge(2.0))
    return rounded(out.select("dataset", "date", "fold", "target", "prediction"), "target", "prediction")


def _final_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Final fits of two features for all products and horizons at once: importance and latest forecasts."""
    features, rows, _ = _by_horizon(spark, sf)
    return L.final_fit(features, settled(rows, "model-rows"), _PAIR, L.ridge(2.0), key=B.KEY)


_PAIR_WHOLE = "SELECT *, 0 AS fold FROM feats WHERE target IS NOT NULL"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {D.ridge_pair(cte, *_PAIR, 2.0, _PAIR_WHOLE)} SELECT dataset, {h} AS horizon, '{x}' AS feature, {D.R(f'abs({z})')} AS importance FROM fit)" for h, cte in zip(HORIZONS, (_MAIN5, _MAIN10), strict=True) for x, z in zip(_PAIR, ("z1", "z2"), strict=True)))
def importance_pair(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_final_pair(spark, sf)[0], "importance")


@query(
    " UNION ALL ".join(
        f"SELECT * FROM (WITH {D.ridge_pair(cte, *_PAIR, 2.0, _PAIR_WHOLE)}, last AS (SELECT * FROM feats QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY date DESC) = 1), scored AS (SELECT dataset, date, close, k + b1 * return_5d_pct + b2 * volatility_20d_pct AS p FROM last JOIN fit USING (dataset))"
        f" SELECT dataset, {h} AS horizon, date, close, {D.R('p')} AS prediction, CASE WHEN p > 0 THEN 1 ELSE -1 END AS signal FROM scored)"
        for h, cte in zip(HORIZONS, (_MAIN5, _MAIN10), strict=True)
    )
)
def latest_forecast_pair(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_final_pair(spark, sf)[1], "prediction")


@query()
def walk_forward_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on every series, a fit of all trees per fold, each in a task of its own."""
    rows, names = _model_rows(spark, sf)
    out = L.walk_forward(M.assign_folds(rows, ["dataset"], 5, start_date=None), names, "target", L.gbt())
    return rounded(out.select("dataset", "date", "fold", "target", "prediction"), "target", "prediction")


def _final_fit(spark: SparkSession, sf: str, learner: L.Ridge | L.Trees) -> tuple[DataFrame, DataFrame]:
    features, _, names = X.add_features(_market(spark, sf), horizon=5)
    features = settled(features, "features")
    model = features.dropna(subset=[X.target_column(5)])
    return L.final_fit(features, X.labelled(model, 5), names, learner)


@query()
def importance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.top_features(_final_fit(spark, sf, L.ridge())[0], 12), "importance")


@query()
def importance_trees(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.top_features(_final_fit(spark, sf, L.gbt())[0], 12), "importance")


@query()
def latest_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_final_fit(spark, sf, L.ridge())[1], "prediction")


@query()
def latest_forecast_trees(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_final_fit(spark, sf, L.gbt())[1], "prediction")


# --- panel studies


@query(f"WITH {D.WIDE} SELECT date, {_sql_rounded([f'{k}_{s}' for s in SYMBOLS for k in ('close', 'ret', 'vol20', 'volume_chg', 'hold_chg')], tuple(f'close_{s}' for s in SYMBOLS))} FROM panel")
def wide_features(spark: SparkSession, sf: str) -> DataFrame:
    out = A.wide_features(_main(spark, sf), SYMBOLS)
    return rounded(out, *[c for c in out.columns if c != "date" and not c.startswith("close")])


@query(f"WITH {D.MAIN} SELECT date, " + ", ".join(f"max(close) FILTER (WHERE symbol = '{s}') AS \"{s}\"" for s in SYMBOLS) + " FROM main GROUP BY date")
def pivot_close(spark: SparkSession, sf: str) -> DataFrame:
    return A.pivot_field(_main(spark, sf), "close", SYMBOLS)


@query(f"WITH {D.PANEL} SELECT symbol, date, {D.R('close / first_value(close) OVER (PARTITION BY symbol ORDER BY date) * 100')} AS price_index FROM long")
def price_index(spark: SparkSession, sf: str) -> DataFrame:
    out = A.price_index(A.common_features(_main(spark, sf), SYMBOLS))
    return rounded(out.select("symbol", "date", "price_index"), "price_index")


@query(f"WITH {D.WIDE} " + " UNION ALL ".join(f"SELECT 'ret_{a}' AS \"left\", 'ret_{b}' AS \"right\", {D.R(f'corr(ret_{a}, ret_{b})')} AS correlation FROM panel" for a in SYMBOLS for b in SYMBOLS))
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.corr_matrix(A.wide_features(_main(spark, sf), SYMBOLS), [f"ret_{s}" for s in SYMBOLS]), "correlation")


def _rolling_sql(a: str, b: str) -> str:
    w = "OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    return f"{D.R(f'CASE WHEN count(CASE WHEN {a} IS NOT NULL THEN {b} END) {w} = 60 THEN corr({a}, {b}) {w} END')} AS corr_{a}_{b}"


@query(f"WITH {D.WIDE} SELECT date, " + ", ".join(_rolling_sql(a, b) for a, b in A.all_pairs(SYMBOLS)) + " FROM panel")
def rolling_corr(spark: SparkSession, sf: str) -> DataFrame:
    out = A.rolling_corr(A.wide_features(_main(spark, sf), SYMBOLS), A.all_pairs(SYMBOLS))
    return rounded(out, *out.columns[1:])


@query(
    f"WITH {D.PANEL}, n AS (SELECT *, CASE WHEN ret IS NOT NULL THEN row_number() OVER (PARTITION BY symbol ORDER BY ret IS NULL, date DESC) END AS nth FROM long)"
    f" SELECT symbol, max(date) AS latest_date, arg_max(close, date) AS latest_close, {D.R('sum(ret) FILTER (WHERE nth <= 5)')} AS return_5d_pct, {D.R('sum(ret) FILTER (WHERE nth <= 20)')} AS return_20d_pct, {D.R('arg_max(vol20, date) FILTER (WHERE vol20 IS NOT NULL)')} AS volatility_20d_pct FROM n GROUP BY symbol"
)
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    out = A.dashboard(A.common_features(_main(spark, sf), SYMBOLS))
    return rounded(out, "return_5d_pct", "return_20d_pct", "volatility_20d_pct")


_RETS = [f"ret_{s}" for s in SYMBOLS]


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return A.wide_features(_main(spark, sf), SYMBOLS).select(F.lit("all").alias("panel"), "date", *_RETS)


def _gram_sql() -> str:
    cols = ["1", *_RETS, *[f"{c}_l1" for c in _RETS]]
    lagged = ", ".join(f"lag({c}) OVER (ORDER BY date) AS {c}_l1" for c in _RETS)
    known = " AND ".join(f"{c} IS NOT NULL" for c in _RETS)
    rows = " UNION ALL ".join(f"SELECT 'all' AS panel, {i} AS i, {j} AS j, round(sum({a} * {b}), 4) AS value FROM lagged WHERE ret_A_l1 IS NOT NULL" for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)
    return f"WITH {D.WIDE}, lagged AS (SELECT *, {lagged} FROM panel WHERE {known}) {rows}"


@query(_gram_sql())
def var_gram(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over the rows that have their one lag."""
    out = V.var_gram(_panel(spark, sf), ["panel"], _RETS, 1).filter("lags = 1")
    return out.select("panel", "i", "j", (F.round(F.col("value") * 1e4, 0) / 1e4).alias("value"))


@query()
def var_fit(spark: SparkSession, sf: str) -> DataFrame:
    return V.var_fit(_panel(spark, sf), ["panel"], _RETS)


def _irf(spark: SparkSession, sf: str) -> DataFrame:
    return V.orth_irf(V.var_fit(_panel(spark, sf), ["panel"], _RETS), ["panel"])


@query()
def irf_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.irf_summary(_irf(spark, sf), ["panel"]), "day0_response", "peak_response", "cumulative_response")


@query()
def top_cross_irf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.top_cross_irf(V.irf_summary(_irf(spark, sf), ["panel"])), "day0_response", "peak_response", "cumulative_response")


@query()
def fevd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.fevd(_irf(spark, sf), key=["panel"]), "share_pct")


def _var1(spark: SparkSession, sf: str) -> DataFrame:
    return V.var_fit(_panel(spark, sf), ["panel"], _RETS, max_lag=1)


@query(f"WITH {D.VAR1} {D.VAR1_FIT}")
def var_fit_one_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients (row 0: constants) and residual covariances of the fit of one lag, by place."""
    fit = settled(_var1(spark, sf), "var")

    def cells(part: str, c: str) -> DataFrame:
        rows = fit.select(F.lit(part).alias("part"), F.posexplode(c).alias("i", "row"))
        return rows.select("part", "i", F.posexplode("row").alias("j", "value"))

    return rounded(cells("coefficient", "coefficients").unionByName(cells("sigma", "sigma")), "value")


def _irf1(spark: SparkSession, sf: str) -> DataFrame:
    return settled(V.orth_irf(_var1(spark, sf), ["panel"]), "irf")


@query(f"WITH {D.VAR1} SELECT response, shock, step, {D.R('value')} AS value FROM responses")
def irf_one_lag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_irf1(spark, sf).drop("panel"), "value")


_PEAKS = f"response, shock, {D.R('day0')} AS day0_response, peak_abs_day, {D.R('peak')} AS peak_response, {D.R('total')} AS cumulative_response FROM peaks"


@query(f"WITH {D.VAR1} SELECT {_PEAKS}")
def irf_summary_one_lag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.irf_summary(_irf1(spark, sf)), "day0_response", "peak_response", "cumulative_response")


@query(f"WITH {D.VAR1} SELECT {_PEAKS} WHERE response <> shock ORDER BY abs(total) DESC, response, shock LIMIT 5")
def top_cross_irf_one_lag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.top_cross_irf(V.irf_summary(_irf1(spark, sf))), "day0_response", "peak_response", "cumulative_response")


_SHARES_SQL = "squares AS (SELECT response, shock, step, sum(value * value) OVER (PARTITION BY response, shock ORDER BY step ROWS UNBOUNDED PRECEDING) AS s FROM responses)"


@query(f"WITH {D.VAR1}, {_SHARES_SQL} SELECT response AS target, step AS horizon_days, shock, {D.R('s / sum(s) OVER (PARTITION BY response, step) * 100')} AS share_pct FROM squares WHERE step IN (1, 5, 10, 20)")
def fevd_one_lag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.fevd(_irf1(spark, sf)), "share_pct")


@query(f"WITH {D.VAR1}, {_SHARES_SQL} SELECT response AS target, step AS horizon_days, shock, {D.R('s / sum(s) OVER (PARTITION BY response, step) * 100')} AS share_pct FROM squares WHERE step = 20")
def fevd_after_20_days(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.fevd_at(V.fevd(_irf1(spark, sf)), 20), "share_pct")


def _series(spark: SparkSession, sf: str) -> DataFrame:
    """log_close and return of each symbol, long."""
    long = A.common_features(_main(spark, sf), SYMBOLS)
    kinds = F.explode(F.array(F.struct(F.lit("log_close").alias("series"), F.ln("close").alias("value")), F.struct(F.lit("return").alias("series"), F.col("ret").alias("value"))))
    return long.select("symbol", "date", kinds.alias("of")).select("symbol", "date", "of.*")


_DF = (
    "pairs AS (SELECT symbol, 'log_close' AS series, date, ln(close) AS y FROM long UNION ALL SELECT symbol, 'return', date, ret FROM long), known AS (SELECT *, lag(y) OVER (PARTITION BY symbol, series ORDER BY date) AS x FROM pairs WHERE y IS NOT NULL)"
    ", sums AS (SELECT symbol, series, count(*) AS n, count(*) * var_pop(x) AS xx, count(*) * covar_pop(x, y - x) AS xy, count(*) * var_pop(y - x) AS yy FROM known WHERE x IS NOT NULL GROUP BY symbol, series)"
)


@query(f"WITH {D.PANEL}, {_DF} SELECT symbol, series, {D.R('(xy / xx) / sqrt((yy - xy * xy / xx) / (n - 2) / xx)')} AS adf_stat, 0 AS used_lag, n AS nobs FROM sums")
def dickey_fuller(spark: SparkSession, sf: str) -> DataFrame:
    """The unit root test without lagged differences."""
    return rounded(V.adf(_series(spark, sf), ["symbol", "series"], "value", max_lag=0).drop("p_value", "stationary_at_5pct"), "adf_stat")


@query()
def adf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.adf(_series(spark, sf), ["symbol", "series"], "value"), "adf_stat", "p_value")


# --- streaming


@query(f"WITH {D.MAIN} SELECT symbol, commodity_slug, date, {_BARS_SQL} FROM main")
def refresh_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrivals of bar files, the first with wrong closes that the second corrects; the table ends up right."""
    rows = _main(spark, sf).select(*[F.col(f.name).cast(f.dataType) for f in BARS.fields])
    rows = rows.withColumn("hold", F.floor(F.col("hold")).cast("long"))
    arrivals, table, checkpoint = (scratch_path(spark, t) for t in ("arrivals", "table", "checkpoint"))
    wrong = rows.withColumn("close", F.when(F.dayofmonth("date") % 2 == 0, F.col("close") + 1).otherwise(F.col("close")))
    for part in (wrong, rows.filter(F.dayofmonth("date") % 2 == 0)):
        part.write.mode("append").parquet(arrivals)
        stream_refresh(spark, arrivals, table, checkpoint).awaitTermination()
    return spark.read.parquet(table).select(*[F.col(f.name).cast(f.dataType) for f in BARS.fields])


@query(ORACLES["weighted_index"])
def refresh_index(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrivals of contract bars: all, with wrong closes of one product, then that product; its index alone is rebuilt."""
    rows = _contracts(spark, sf)
    arrivals, contracts, index, features, checkpoint = (scratch_path(spark, t) for t in ("arrivals", "contracts", "index", "features", "checkpoint"))
    first = F.col("product") == "A"
    for part in (rows.withColumn("close", F.when(first, F.col("close") + 1).otherwise(F.col("close"))), rows.filter(first)):
        part.write.mode("append").parquet(arrivals)
        stream_index(spark, arrivals, contracts, index, features, checkpoint, rows.schema).awaitTermination()
    return both_rounded(spark.read.parquet(index), [n for n in _INDEX_NAMES if n not in _INDEX_PLAIN]).select("product", "date", *_INDEX_NAMES)
