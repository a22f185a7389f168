"""DuckDB SQL of the registered panel queries, put together from common table expressions."""

from __future__ import annotations

from barloom.operators.features import CHANGES, RETURNS, SCORES, WINDOWS

#: Six digits; halves, which different orders of summing miss by a hair, all go up.
R = "(round(({}) * 1e6 + 0.003) / 1e6 + 0.0)".format
#: Seven significant digits, for values of any size; halves go up here too.
S = "CAST(printf('%.6e', ({}) * 1.0000000003) AS DOUBLE)".format

LINES = "li AS (SELECT *, l_extendedprice / l_quantity AS px, row(l_orderkey, l_partkey, l_suppkey, l_linenumber) AS k, CAST(l_shipdate AS DATE) AS date FROM lineitem)"
_OHLC = "arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, round(sum(l_extendedprice), 2) / sum(l_quantity) AS settle, sum(l_quantity) AS volume"
MAIN = f"{LINES}, main AS (SELECT l_returnflag AS symbol, lower(l_returnflag) AS commodity_slug, date, {_OHLC}, round(sum(l_extendedprice * (1 - l_discount)), 4) AS hold FROM li GROUP BY l_returnflag, date)"
CONTRACTS = f"{LINES}, contracts AS (SELECT l_returnflag AS product, l_returnflag || l_linenumber AS contract, date, {_OHLC}, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS hold FROM li GROUP BY l_returnflag, l_linenumber, date)"


def ln_pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 AND ({a}) / ({b}) > 0 THEN ln(({a}) / ({b})) * 100 END"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def full(agg: str, col: str, n: int, by: str = "dataset") -> str:
    frame = f"OVER (PARTITION BY {by} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {frame} = {n} THEN {agg}({col}) {frame} END"


def lag(col: str, n: int = 1, by: str = "dataset") -> str:
    return f"lag({col}, {n}) OVER (PARTITION BY {by} ORDER BY date)"


RETURNS_CTE = (
    f"{CONTRACTS}, prev AS (SELECT *, "
    + ", ".join(f"{lag(c, 1, 'product, contract')} AS prev_{c}" for c in ("close", "volume", "hold"))
    + f" FROM contracts), returns AS (SELECT *, {ln_pct('close', 'prev_close')} AS contract_return_pct FROM prev)"
)


def _rank(weight: str) -> str:
    w = f"CASE WHEN {weight} > 0 THEN {weight} END"
    return f"CASE WHEN {weight} > 0 THEN row_number() OVER (PARTITION BY product, date ORDER BY {w} DESC NULLS LAST, contract) END"


def wavg(value: str, weight: str) -> str:
    ok = f"FILTER (WHERE r.{value} IS NOT NULL AND r.{weight} > 0)"
    return f"(sum(r.{value} * r.{weight}) {ok} / sum(r.{weight}) {ok})"


WEIGHTS = {"volume": "volume", "hold": "oi"}
PRICES = ("open", "high", "low", "close", "settle")
TOTALS = {"active_contracts": "count(*) FILTER (WHERE r.volume > 0 OR r.hold > 0)", "volume": "coalesce(sum(r.volume), 0)", "open_interest": "coalesce(sum(r.hold), 0)"}
for _w, _n in WEIGHTS.items():
    TOTALS[f"{_n}_weighted_return_pct"] = wavg("contract_return_pct", f"prev_{_w}")
    TOTALS |= {f"{_n}_weighted_{p}": wavg(p, _w) for p in PRICES}


def rank_columns(weight: str, name: str) -> dict[str, str]:
    at = lambda n, c: f"max(r.{c}) FILTER (WHERE r.{name}_rank = {n})"
    total = f"sum(r.{weight}) FILTER (WHERE r.{weight} > 0)"
    second = f"coalesce({at(2, weight)}, 0)"
    return {
        f"dominant_{name}_contract": at(1, "contract"),
        f"dominant_{name}_share": f"{at(1, weight)} / {total}",
        f"second_{name}_share": f"{second} / {total}",
        f"{name}_roll_pressure": f"{second} / {at(1, weight)}",
    }


RANKS = {k: v for w, n in WEIGHTS.items() for k, v in rank_columns(w, n).items()}
RANKED = f"{RETURNS_CTE}, ranked AS (SELECT *, {_rank('volume')} AS volume_rank, {_rank('hold')} AS oi_rank FROM returns)"
DAYS = f"{RANKED}, days AS (SELECT r.product, r.date, " + ", ".join(f"{v} AS {k}" for k, v in (TOTALS | RANKS).items()) + " FROM ranked r GROUP BY r.product, r.date)"
_W = "(PARTITION BY product ORDER BY date)"
CHANGED = {n: f"CASE WHEN row_number() OVER {_W} = 1 THEN 0 ELSE CAST({c} IS DISTINCT FROM lag({c}) OVER {_W} AS INT) END" for n, c in (("dominant_contract_changed", "dominant_oi_contract"), ("dominant_volume_contract_changed", "dominant_volume_contract"))}
INDEX = (
    f"{DAYS}, anchored AS (SELECT *, "
    + ", ".join(f"{v} AS {k}" for k, v in CHANGED.items())
    + f", (oi_weighted_close IS NOT NULL AND (count(oi_weighted_close) OVER (PARTITION BY product ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 OR oi_weighted_return_pct IS NULL)) AS anchor FROM days)"
    + f", segments AS (SELECT *, sum(CAST(anchor AS INT)) OVER {_W} AS seg FROM anchored)"
    + ", levels AS (SELECT *, CASE WHEN seg > 0 THEN first_value(oi_weighted_close) OVER s * exp(sum(CASE WHEN anchor THEN 0 ELSE coalesce(oi_weighted_return_pct, 0) END) OVER s / 100) END AS return_index_close FROM segments WINDOW s AS (PARTITION BY product, seg ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
    + ", idx AS (SELECT *, "
    + ", ".join(f"volume_weighted_{p} * {div('return_index_close', 'volume_weighted_close')} AS {p}" for p in PRICES if p != "close")
    + ", return_index_close AS close FROM levels)"
)

MAIN_MARKET = f"{MAIN}, market AS (SELECT symbol AS dataset, date, open, high, low, close, volume, settle, hold AS open_interest FROM main)"
WEIGHTED = ("active_contracts", "dominant_volume_share", "second_volume_share", "dominant_oi_share", "second_oi_share", "volume_roll_pressure", "oi_roll_pressure", "dominant_contract_changed", "dominant_volume_contract_changed")
INDEX_MARKET = f"{INDEX}, market AS (SELECT product || '_weighted' AS dataset, date, open, high, low, close, volume, settle, open_interest, oi_weighted_close, " + ", ".join(WEIGHTED) + " FROM idx)"


def features(market: str, horizon: int, weighted: bool = False) -> tuple[str, list[str]]:
    """CTEs up to feats (feature rows), and the features' names."""
    new = {f"return_{n}d_pct": ln_pct("close", lag("close", n)) for n in RETURNS}
    for n in WINDOWS:
        new[f"volatility_{n}d_pct"] = full("stddev_samp", "daily_return_pct", n)
        new[f"ma_gap_{n}d_pct"] = f"({div('close', full('avg', 'close', n))} - 1) * 100"
    for n in CHANGES:
        new[f"volume_change_{n}d_pct"] = ln_pct("v", lag("v", n))
        new[f"open_interest_change_{n}d_pct"] = ln_pct("oi", lag("oi", n))
    for n in SCORES:
        new[f"open_interest_zscore_{n}d"] = div(f"oi - {full('avg', 'oi', n)}", full("stddev_samp", "oi", n))
    new["intraday_range_pct"] = f"{div('high - low', 'close')} * 100"
    new["settle_close_spread_pct"] = f"{div('settle - close', 'close')} * 100"
    if weighted:
        new["oi_volume_weighted_close_gap_pct"] = f"{div('oi_weighted_close - close', 'close')} * 100"
    names = [*new, *(WEIGHTED if weighted else ())]
    target = ln_pct(f"lead(close, {horizon}) OVER (PARTITION BY dataset ORDER BY date)", "close")
    cte = (
        f"{market}, daily AS (SELECT *, nullif(volume, 0) AS v, nullif(open_interest, 0) AS oi, {ln_pct('close', lag('close'))} AS daily_return_pct FROM market)"
        + ", wide AS (SELECT *, "
        + ", ".join(f"{v} AS {k}" for k, v in new.items())
        + f", {target} AS target FROM daily)"
        + ", feats AS (SELECT *, CASE WHEN target > 0 THEN 1 ELSE 0 END AS up FROM wide WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in names)
        + ")"
    )
    return cte, names


def folds(cte: str, horizon: int, start_date: str | None = None, ratio: float = 0.6, min_train: int = 252, test_rows: int = 63, purge: int | None = None, keys: str = "dataset") -> str:
    """CTEs up to folded (model rows with position, start, fold, train_end)."""
    first = f"min(CASE WHEN date >= DATE '{start_date}' THEN position END) OVER (PARTITION BY {keys})" if start_date else "CAST(NULL AS BIGINT)"
    late = f"greatest(CAST(floor({ratio} * count(*) OVER (PARTITION BY {keys})) AS BIGINT), {min_train})"
    gap = horizon if purge is None else purge
    return (
        f"{cte}, placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS position FROM feats WHERE target IS NOT NULL)"
        f", started AS (SELECT *, CASE WHEN {first} >= {min_train} THEN {first} ELSE {late} END AS start FROM placed)"
        f", numbered AS (SELECT *, CAST(floor((position - start) / {float(test_rows)}) AS INT) AS f FROM started)"
        f", ended AS (SELECT *, greatest(start + f * {test_rows} - {gap}, 0) AS e FROM numbered)"
        f", folded AS (SELECT *, CASE WHEN f >= 0 AND e >= {min_train} THEN f END AS fold, CASE WHEN f >= 0 AND e >= {min_train} THEN e END AS train_end FROM ended)"
    )


def backtest(cte: str, prediction: str = "return_5d_pct", cost: float = 0.02) -> str:
    """CTEs up to bt (tested rows with signal, position, turnover, returns and equities)."""
    w = "(PARTITION BY dataset ORDER BY date)"
    upto = "(PARTITION BY dataset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (
        f"{cte}, pred AS (SELECT *, {prediction} AS prediction FROM folded WHERE fold IS NOT NULL)"
        ", signalled AS (SELECT *, CASE WHEN prediction > 0 THEN 1 ELSE -1 END AS signal FROM pred)"
        f", held AS (SELECT *, coalesce(lag(signal) OVER {w}, 0) AS position_ FROM signalled)"
        f", turned AS (SELECT *, abs(position_ - coalesce(lag(position_) OVER {w}, 0)) AS turnover FROM held)"
        f", earned AS (SELECT *, position_ * daily_return_pct - turnover * {cost} AS strategy FROM turned)"
        f", bt AS (SELECT *, exp(sum(strategy) OVER {upto} / 100) AS strategy_equity, exp(sum(daily_return_pct) OVER {upto} / 100) AS buy_hold_equity FROM earned)"
    )


def metrics(cte: str) -> str:
    return (
        f"{cte}, falls AS (SELECT *, strategy_equity / max(strategy_equity) OVER (PARTITION BY dataset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS fall FROM bt)"
        ", scored AS (SELECT dataset, count(*) AS rows, min(date) AS backtest_start_date, max(date) AS backtest_end_date"
        f", {R('avg(abs(target - prediction))')} AS mae, {R('sqrt(avg((target - prediction) * (target - prediction)))')} AS rmse"
        f", {R('1 - sum((target - prediction) * (target - prediction)) / (var_pop(target) * count(target))')} AS r2"
        f", {R('avg(CAST(sign(target) = sign(prediction) AS DOUBLE))')} AS directional_accuracy"
        f", {R('(arg_max(strategy_equity, date) - 1) * 100')} AS strategy_total_return_pct, {R('(arg_max(buy_hold_equity, date) - 1) * 100')} AS buy_hold_total_return_pct"
        f", {R('avg(strategy) * 252')} AS strategy_annual_return_pct, {R('stddev_pop(strategy) * sqrt(252)')} AS strategy_annual_vol_pct"
        f", {R('avg(strategy) * 252 / nullif(stddev_pop(strategy) * sqrt(252), 0)')} AS strategy_sharpe, {R('min(fall) * 100')} AS max_drawdown_pct"
        ", count(*) FILTER (WHERE turnover > 0) AS trade_count FROM falls GROUP BY dataset)"
        ", known AS (SELECT dataset, count(*) AS trainable_rows, min(date) AS model_start_date, max(date) AS model_end_date FROM folded GROUP BY dataset)"
    )


def quality(cte: str) -> str:
    right = "CASE WHEN prediction > 0 THEN target > 0 ELSE target < 0 END"
    return (
        f"{cte}, judged AS (SELECT *, CASE WHEN prediction > 0 THEN 'bullish' ELSE 'bearish' END AS forecast, coalesce({right}, false) AS ok FROM pred)"
        f", quality AS (SELECT dataset, forecast, count(*) AS samples, {R('avg(prediction)')} AS avg_predicted_return_pct, {R('avg(target)')} AS avg_realized_return_pct"
        f", {R('median(target)')} AS median_realized_return_pct, {R('avg(CAST(ok AS DOUBLE))')} AS direction_accuracy"
        f", {R('count(*) / sum(count(*)) OVER (PARTITION BY dataset)')} AS sample_share FROM judged GROUP BY dataset, forecast)"
    )


SYMBOLS = ("A", "N", "R")
PANEL = (
    f"{MAIN}, common AS (SELECT * FROM main WHERE close IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) = {len(SYMBOLS)})"
    + ", logs AS (SELECT *, ln(CASE WHEN close > 0 THEN close END) AS lc, ln(CASE WHEN volume > 0 THEN volume END) AS lv, ln(CASE WHEN hold > 0 THEN hold END) AS lh FROM common)"
    + ", moves AS (SELECT symbol, date, close, "
    + ", ".join(f"({c} - {lag(c, 1, 'symbol')}) * 100 AS {n}" for c, n in (("lc", "r"), ("lv", "volume_chg"), ("lh", "hold_chg")))
    + f" FROM logs), marked AS (SELECT *, count(r) OVER (PARTITION BY date) = {len(SYMBOLS)} AS known FROM moves)"
    + f", long AS (SELECT symbol, date, close, CASE WHEN known THEN r END AS ret, CASE WHEN known THEN {full('stddev_samp', 'r', 20, 'symbol, known')} END AS vol20, volume_chg, hold_chg FROM marked)"
)
WIDE = (
    f"{PANEL}, panel AS (SELECT date, "
    + ", ".join(f"max({k}) FILTER (WHERE symbol = '{s}') AS {k}_{s}" for s in SYMBOLS for k in ("close", "ret", "vol20", "volume_chg", "hold_chg"))
    + " FROM long GROUP BY date)"
)


# --- a vector autoregression of one lag, by the adjugate of a 3 x 3 matrix

_C = [f"ret_{s}" for s in SYMBOLS]
_N = range(3)


def _var1() -> str:
    """CTEs up to irf (step and m<response><shock>), from b<regressor><equation>, k<equation> and s<row><column>."""
    cov = lambda a, b: f"count(*) * covar_pop({a}, {b})"
    sums = [f"{cov(f'x{i}', f'x{j}')} AS c{i}{j}" for i in _N for j in _N if i <= j]
    sums += [f"{cov(f'x{i}', f'y{j}')} AS d{i}{j}" for i in _N for j in _N]
    sums += [f"{cov(f'y{i}', f'y{j}')} AS e{i}{j}" for i in _N for j in _N if i <= j]
    sums += [f"avg({v}{i}) AS {v}m{i}" for v in "xy" for i in _N]
    inverse = {"00": "c11 * c22 - c12 * c12", "01": "c02 * c12 - c01 * c22", "02": "c01 * c12 - c02 * c11", "11": "c00 * c22 - c02 * c02", "12": "c01 * c02 - c00 * c12", "22": "c00 * c11 - c01 * c01"}
    at = lambda i, j: f"i{min(i, j)}{max(i, j)}"
    product = lambda terms: " + ".join(terms)
    slopes = [f"({product(f'{at(i, k)} * d{k}{j}' for k in _N)}) / det AS b{i}{j}" for i in _N for j in _N]
    constants = [f"ym{j} - ({product(f'b{i}{j} * xm{i}' for i in _N)}) AS k{j}" for j in _N]
    errors = [f"(e{i}{j} - ({product(f'b{k}{i} * d{k}{j}' for k in _N)})) / (n - 4) AS s{i}{j}" for i in _N for j in _N if i <= j]
    root = ["sqrt(s00) AS m00", "CAST(0 AS DOUBLE) AS m01", "CAST(0 AS DOUBLE) AS m02", "s01 / sqrt(s00) AS m10", "sqrt(s11 - pow(s01, 2) / s00) AS m11", "CAST(0 AS DOUBLE) AS m12", "s02 / sqrt(s00) AS m20", "(s12 - s02 * s01 / s00) / sqrt(s11 - pow(s01, 2) / s00) AS m21"]
    root.append("sqrt(s22 - pow(s02, 2) / s00 - pow((s12 - s02 * s01 / s00) / sqrt(s11 - pow(s01, 2) / s00), 2)) AS m22")
    steps = [f"{product(f'b{k}{r} * m{k}{s}' for k in _N)} AS m{r}{s}" for r in _N for s in _N]
    return (
        f"{WIDE}, known AS (SELECT date, {', '.join(f'{c} AS y{i}' for i, c in enumerate(_C))} FROM panel WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _C)})"
        f", lagged AS (SELECT *, {', '.join(f'lag(y{i}) OVER (ORDER BY date) AS x{i}' for i in _N)} FROM known)"
        f", sums AS (SELECT count(*) AS n, {', '.join(sums)} FROM lagged WHERE x0 IS NOT NULL)"
        f", inverse AS (SELECT *, {', '.join(f'{v} AS i{k}' for k, v in inverse.items())}, c00 * ({inverse['00']}) + c01 * ({inverse['01']}) + c02 * ({inverse['02']}) AS det FROM sums)"
        f", slopes AS (SELECT *, {', '.join(slopes)} FROM inverse), fit AS (SELECT *, {', '.join([*constants, *errors])} FROM slopes)"
        f", irf AS (WITH RECURSIVE r AS (SELECT 0 AS step, {', '.join(root)}, {', '.join(f'b{i}{j}' for i in _N for j in _N)} FROM fit"
        f" UNION ALL SELECT step + 1, {', '.join(steps)}, {', '.join(f'b{i}{j}' for i in _N for j in _N)} FROM r WHERE step < 20) SELECT * FROM r)"
        f", responses AS ({' UNION ALL '.join(f'''SELECT '{_C[r]}' AS response, '{_C[s]}' AS shock, step, m{r}{s} AS value FROM irf''' for r in _N for s in _N)})"
        ", later AS (SELECT *, row_number() OVER (PARTITION BY response, shock ORDER BY abs(value) DESC, step) AS nth FROM responses WHERE step > 0)"
        ", peaks AS (SELECT l.response, l.shock, max(z.value) AS day0, max(l.step) FILTER (WHERE nth = 1) AS peak_abs_day, max(l.value) FILTER (WHERE nth = 1) AS peak, sum(l.value) AS total FROM later l JOIN responses z ON z.response = l.response AND z.shock = l.shock AND z.step = 0 GROUP BY l.response, l.shock)"
    )


VAR1 = _var1()
VAR1_FIT = " UNION ALL ".join(
    [f"SELECT 'coefficient' AS part, 0 AS i, {j} AS j, {R(f'k{j}')} AS value FROM fit" for j in _N]
    + [f"SELECT 'coefficient' AS part, {i + 1} AS i, {j} AS j, {R(f'b{i}{j}')} AS value FROM fit" for i in _N for j in _N]
    + [f"SELECT 'sigma' AS part, {i} AS i, {j} AS j, {R(f's{min(i, j)}{max(i, j)}')} AS value FROM fit" for i in _N for j in _N]
)


def ridge_pair(cte: str, x1: str, x2: str, penalty: float, train: str) -> str:
    """CTEs up to fit (dataset, fold, slopes b1 and b2, standardised slopes z1 and z2, constant k); train: rows d, fold and f (the folded rows)."""
    cov = lambda a, b: f"count(*) * covar_pop({a}, {b})"
    return (
        f"{cte}, train AS ({train})"
        f", moments AS (SELECT dataset, fold, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg(target) AS my, {cov(x1, x1)} AS c11, {cov(x1, x2)} AS c12, {cov(x2, x2)} AS c22, {cov(x1, 'target')} AS d1, {cov(x2, 'target')} AS d2 FROM train GROUP BY dataset, fold)"
        f", scaled AS (SELECT *, sqrt(c11 / n) AS g1, sqrt(c22 / n) AS g2 FROM moments)"
        f", system AS (SELECT *, c11 / (g1 * g1) + {penalty} AS a11, c12 / (g1 * g2) AS a12, c22 / (g2 * g2) + {penalty} AS a22, d1 / g1 AS r1, d2 / g2 AS r2 FROM scaled)"
        ", solved AS (SELECT *, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS z1, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS z2 FROM system)"
        ", fit AS (SELECT dataset, fold, z1, z2, z1 / g1 AS b1, z2 / g2 AS b2, my - z1 / g1 * m1 - z2 / g2 * m2 AS k FROM solved)"
    )
