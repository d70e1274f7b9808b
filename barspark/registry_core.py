"""Queries of the bar pipeline: resampling, indicators, signals, positions,
ledger and metrics, on the daily bars derived from ``orders`` (F0 -> F1) and
the hourly bars derived from ``events`` (F2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from . import params as P
from .operators import backtest as BT
from .operators import indicators as I
from .operators import metrics, positions, signals
from .operators.resample import resample_bars, resample_ohlcv
from .registry import finalize, memo, register
from .session import cut_lineage
from .sources.fixtures import blackout_dates, ticks_events, ticks_orders

r6 = O.r6
DEFAULT = P.RunParams()
BIAS = P.RunParams(use_bias=True, run_id="bias")


def daily_bars(spark, sf):
    return resample_bars(ticks_orders(spark, sf), "Daily")


def indicators(spark, sf, bb=P.BB_BASE_WINDOW):
    def build():
        return I.compute_indicators(daily_bars(spark, sf), ["symbol"], bb_window=bb, trend_method=None)
    return memo(spark, ("ind", sf, bb), build)


def result(spark, sf, p: P.RunParams = DEFAULT):
    def build():
        res = BT.resolve_indicators(indicators(spark, sf, p.bb_window), blackout_dates(spark), p, ["symbol"])
        return BT.ledger_outputs(res, ["symbol"])
    return memo(spark, ("bt", sf, p), build)


def _ind_sql(cols: str, trend: str | None = None) -> str:
    return O.daily_indicators_with(trend or "none") + f" SELECT symbol, ts, idx, {cols} FROM ind"


def _bt_sql(body: str, p: P.RunParams = DEFAULT) -> str:
    return O.daily_backtest_with(p) + body


def _ind_q(cols):
    def q(spark, sf):
        return finalize(indicators(spark, sf).select("symbol", "ts", "idx", *cols))
    return q


# --- resampling ---------------------------------------------------------------
register("resample_bars", f"""SELECT symbol, ts, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low,
  {r6('close')} AS close, {r6('vwap')} AS vwap, {r6('volume')} AS volume
  FROM ({O.bars_sql(O.ticks_orders_sql(), 86400)}) b""")(
    lambda spark, sf: finalize(daily_bars(spark, sf)))

register("resample_ohlcv", f"""SELECT symbol, ts, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low,
  {r6('close')} AS close, {r6('volume')} AS volume
  FROM ({O.bars_sql(O.ticks_events_sql(), 3600, vwap=False)}) b""")(
    lambda spark, sf: finalize(resample_ohlcv(ticks_events(spark, sf), "1h")))

# --- indicators ------------------------------------------------------------------
IND = {
    "ind_bollinger": ["bb_mid", "bb_upper", "bb_lower"],
    "ind_rsi": ["rsi"],
    "ind_true_range": ["tr"],
    "ind_atr": ["atr"],
    "ind_directional": ["plus_di", "minus_di"],
    "ind_adx": ["adx"],
    "ind_vwap_sma": ["vwap_sma20"],
    "ind_bb_tightening": ["bb_width", "bb_tightening"],
    "ind_hv": ["hv"],
    "indicators_all": ["open", "high", "low", "close", "vwap", "volume", "bb_mid", "bb_upper", "bb_lower", "rsi",
                       "atr", "plus_di", "minus_di", "adx", "vwap_sma20", "bb_width", "bb_tightening", "hv"],
}
for _k, _cols in IND.items():
    _sql_cols = ", ".join(c if c == "bb_tightening" else f"{r6(c)} AS {c}" for c in _cols)
    register(_k, _ind_sql(_sql_cols))(_ind_q(_cols))


@register("ind_bollinger_close", f"""WITH b AS ({O.bars_sql(O.ticks_orders_sql(), 86400)}),
  i AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM b),
  m AS (SELECT symbol, ts, idx,
    CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS bb_mid,
    CASE WHEN count(close) OVER w = 20 THEN stddev_pop(close) OVER w END AS s
    FROM i WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT symbol, ts, idx, {r6('bb_mid', 4)} AS bb_mid, {r6('bb_mid + 2.0 * s', 4)} AS bb_upper,
    {r6('bb_mid - 2.0 * s', 4)} AS bb_lower FROM m""")
def q_bollinger_close(spark, sf):
    # 7-decimal prices: 20-bar means sit on 6-decimal ties, so compare at 4
    return finalize(I.bollinger(daily_bars(spark, sf), ["symbol"], column="close"), digits=4)


@register("ewm_mean", f"""WITH RECURSIVE b AS ({O.bars_sql(O.ticks_orders_sql(), 86400)}),
  i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM b),
  e AS (SELECT symbol, idx, close AS y, 0 AS c FROM i WHERE idx = 0
        UNION ALL
        SELECT n.symbol, n.idx, {O._ewm_step('e.y', 'e.c', 'n.close')}, {O._ewm_count('e.y', 'e.c', 'n.close')}
        FROM e JOIN i n ON n.symbol = e.symbol AND n.idx = e.idx + 1)
  SELECT i.symbol, i.ts, i.idx, {r6('e.y')} AS ewm FROM i JOIN e USING (symbol, idx)""")
def q_ewm(spark, sf):
    return finalize(I.ewm_series(daily_bars(spark, sf), ["symbol"], "close"))


for _k, _m in (("trend_vwap_slope", "VWAP Slope"), ("trend_vwap_vs_sma", "VWAP vs SMA20"),
               ("trend_adx_di", "ADX + DI"), ("trend_none", "none")):
    register(_k, O.daily_indicators_with(_m) + " SELECT symbol, ts, idx, trend_up, trend_down FROM ind")(
        (lambda m: lambda spark, sf: finalize(
            I.trend_flags(indicators(spark, sf), m).select("symbol", "ts", "idx", "trend_up", "trend_down")))(_m))


@register("validate_indicators", O.daily_indicators_with() + """ SELECT symbol,
  count(bb_mid) > 0 AND count(bb_upper) > 0 AND count(bb_lower) > 0 AND count(rsi) > 0 AND count(adx) > 0
  AND count(plus_di) > 0 AND count(minus_di) > 0 AND count(hv) > 0 AND count(vwap_sma20) > 0
  AND count(bb_width) > 0 AND count(bb_tightening) > 0 AS indicators_valid FROM ind GROUP BY symbol""")
def q_validate(spark, sf):
    return finalize(I.validate_indicators(indicators(spark, sf)))


# --- signals -------------------------------------------------------------------
register("blackout_mask", _bt_sql(" SELECT symbol, ts, idx, blackout FROM sig"))(
    lambda spark, sf: finalize(result(spark, sf).bars.select("symbol", "ts", "idx", "blackout")))

register("entry_eligible", _bt_sql(
    " SELECT symbol, ts, idx, cond_adx, cond_rsi, cond_hv, blackout, eligible FROM sig"))(
    lambda spark, sf: finalize(result(spark, sf).bars.select(
        "symbol", "ts", "idx", "cond_adx", "cond_rsi", "cond_hv", "blackout", "eligible")))

_REASONS = ("concat_ws(', ', CASE WHEN NOT cond_hv THEN 'HV outside range' END, CASE WHEN NOT cond_adx THEN "
            "'ADX too high' END, CASE WHEN NOT cond_rsi THEN 'RSI out of range' END, CASE WHEN blackout THEN "
            "'Blackout window' END)")
register("rejections", _bt_sql(f""" SELECT symbol, ts AS date,
  CASE WHEN {_REASONS} = '' THEN 'Not eligible' ELSE {_REASONS} END AS reasons,
  {r6('adx')} AS adx, {r6('rsi')} AS rsi, {r6('hv')} AS hv, blackout FROM sig WHERE NOT eligible"""))(
    lambda spark, sf: finalize(result(spark, sf).rejected))

register("rejection_reasons", _bt_sql(f""", rj AS (SELECT symbol, {_REASONS} AS reasons FROM sig WHERE NOT eligible),
  tot AS (SELECT symbol, count(*) AS n FROM rj GROUP BY symbol),
  per AS (SELECT symbol, reason, count(*) AS cnt FROM (SELECT symbol, unnest(string_split(reasons, ', ')) AS reason
          FROM rj) x GROUP BY symbol, reason)
  SELECT per.symbol, reason, cnt AS count, {r6('100.0 * cnt / n')} AS pct FROM per JOIN tot USING (symbol)"""))(
    lambda spark, sf: finalize(signals.rejection_reasons(result(spark, sf).rejected)))

# --- positions -----------------------------------------------------------------
_ENTRY = "eligible AND strikes_ok"


def _pos(cols, p=DEFAULT, cond="eligible"):
    def q(spark, sf):
        return finalize(result(spark, sf, p).bars.filter(cond).select(*cols))
    return q


def _sqlcols(cols):
    return ", ".join(f"{r6(c)} AS {c}" if c in _DOUBLES else c for c in cols)


_DOUBLES = {"short_put", "short_call", "long_put", "long_call", "net_credit", "put_wing", "call_wing", "pnl",
            "exit_close", "exit_pnl", "cash", "bb_lower", "bb_upper"}
for _k, _cols, _p, _cond in (
        ("strikes", ["symbol", "ts", "idx", "short_put", "short_call"], BIAS, "eligible"),
        ("wings", ["symbol", "ts", "idx", "put_wing", "call_wing", "long_put", "long_call"], DEFAULT, "eligible"),
        ("credit", ["symbol", "ts", "idx", "net_credit"], DEFAULT, "eligible"),
        ("expiry_bar", ["symbol", "ts", "idx", "expiry_off"], DEFAULT, "eligible"),
        ("vwap_exit_signal", ["symbol", "ts", "idx", "vwap_hit", "adx_hit"], DEFAULT, "true"),
        ("position_exit", ["symbol", "ts", "idx", "exit_off", "rule_exit", "outcome", "exit_close", "pnl"], DEFAULT,
         _ENTRY + " AND exit_off IS NOT NULL"),
):
    register(_k, O.daily_backtest_with(_p) + f" SELECT {_sqlcols(_cols)} FROM res WHERE {_cond}")(
        _pos(_cols, _p, _cond))

register("unresolved_positions", _bt_sql(f""" SELECT symbol, idx AS entry_idx, ts AS entry_date,
  idx + expiry_off AS expiry_idx, {_sqlcols(['short_put', 'long_put', 'short_call', 'long_call', 'net_credit'])}
  FROM res WHERE {_ENTRY} AND expiry_off = 0"""))(
    lambda spark, sf: finalize(positions.unresolved_positions(result(spark, sf).bars)))

register("condor_pnl", _bt_sql(f""" SELECT symbol, idx AS entry_idx, idx + exit_off AS exit_idx,
  {r6('exit_close')} AS price, {r6('pnl')} AS pnl,
  exit_close >= short_put AND exit_close <= short_call AS inside FROM res WHERE {_ENTRY} AND exit_off IS NOT NULL"""))(
    lambda spark, sf: finalize(result(spark, sf).bars.filter(F.expr(_ENTRY + " AND exit_off IS NOT NULL")).select(
        "symbol", F.col("idx").alias("entry_idx"), (F.col("idx") + F.col("exit_off")).alias("exit_idx"),
        F.col("exit_close").alias("price"), "pnl",
        ((F.col("exit_close") >= F.col("short_put")) & (F.col("exit_close") <= F.col("short_call"))).alias("inside"))))

_TRADE_COLS = ["symbol", "entry_date", "expiry_date", "short_put", "long_put", "short_call", "long_call",
               "net_credit", "expiry_close", "pnl", "outcome", "cum_pnl"]
register("trades", _bt_sql(" SELECT " + ", ".join(
    f"{r6(c)} AS {c}" if c in {"short_put", "long_put", "short_call", "long_call", "net_credit", "expiry_close", "pnl",
                             "cum_pnl"} else c for c in _TRADE_COLS) + ", trade_no FROM trades"))(
    lambda spark, sf: finalize(result(spark, sf).trades.select(*_TRADE_COLS, "trade_no")))

register("equity_curve", _bt_sql(f" SELECT symbol, ts AS date, {r6('cash')} AS cash FROM equity"))(
    lambda spark, sf: finalize(BT.equity_view(result(spark, sf).equity)))

register("drawdown_series", _bt_sql(
    f" SELECT symbol, ts AS date, {r6('cash')} AS cash, {r6('peak')} AS peak, {r6('drawdown')} AS drawdown FROM dd2"))(
    lambda spark, sf: finalize(result(spark, sf).drawdown.select(
        "symbol", F.col("ts").alias("date"), "cash", "peak", "drawdown")))

# --- metrics -------------------------------------------------------------------
SUMMARY_COLS = ["trades", "wins", "losses", "breaches", "adx_exits", "vwap_exits", "brokes", "win_rate", "total_pnl",
                "max_drawdown", "max_drawdown_pct", "profit_factor", "avg_pnl", "avg_win", "avg_loss",
                "reward_risk_ratio", "best_trade", "worst_trade", "win_streak", "loss_streak", "return_on_risk_pct",
                "total_wins", "total_losses", "avg_risk", "total_risk"]
_INTS = {"trades", "wins", "losses", "breaches", "adx_exits", "vwap_exits", "brokes", "win_streak", "loss_streak"}


def _summ_q(cols):
    def q(spark, sf):
        return finalize(result(spark, sf).summary.select("symbol", *cols))
    return q


def _summ_sql(cols):
    sel = ", ".join(c if c in _INTS else f"{r6(c)} AS {c}" for c in cols)
    return _bt_sql(O.summary_select() + f" SELECT symbol, {sel} FROM summary")


for _k, _cols in (
        ("backtest", SUMMARY_COLS),
        ("summary", SUMMARY_COLS),
        ("outcome_counts", ["trades", "wins", "losses", "breaches", "adx_exits", "vwap_exits", "brokes"]),
        ("win_rate", ["trades", "wins", "win_rate"]),
        ("pnl_stats", ["total_pnl", "avg_pnl", "best_trade", "worst_trade", "avg_win", "total_wins", "avg_loss",
                       "total_losses"]),
        ("profit_factor", ["total_wins", "total_losses", "profit_factor"]),
        ("reward_risk", ["avg_win", "avg_loss", "reward_risk_ratio"]),
        ("streaks", ["win_streak", "loss_streak"]),
        ("risk_stats", ["avg_risk", "total_risk", "return_on_risk_pct"]),
        ("max_drawdown", ["max_drawdown", "max_drawdown_pct"]),
):
    register(_k, _summ_sql(_cols))(_summ_q(_cols))

register("monthly_breakdown", _bt_sql(f""" SELECT symbol, strftime(expiry_date, '%Y-%m') AS month,
  {r6('sum(pnl)')} AS pnl, count(*) AS trades, {r6("100.0 * count(*) FILTER (WHERE outcome = 'win') / count(*)")}
  AS win_rate FROM trades GROUP BY symbol, strftime(expiry_date, '%Y-%m')"""))(
    lambda spark, sf: finalize(metrics.monthly_breakdown(result(spark, sf).trades)))

register("pnl_histogram", _bt_sql(f""", rg AS (SELECT symbol,
    CASE WHEN min(pnl) = max(pnl) THEN min(pnl) - 0.5 ELSE min(pnl) END AS lo,
    CASE WHEN min(pnl) = max(pnl) THEN max(pnl) + 0.5 ELSE max(pnl) END AS hi FROM trades GROUP BY symbol),
  cnt AS (SELECT t.symbol, least(CAST(floor((pnl - lo) / ((hi - lo) / 20.0)) AS INTEGER), 19) AS bin, count(*) AS n
    FROM trades t JOIN rg USING (symbol) GROUP BY ALL),
  grid AS (SELECT symbol, lo, hi, unnest(range(0, 20)) AS bin FROM rg)
  SELECT grid.symbol, CAST(grid.bin AS BIGINT) AS bin, {r6('lo + (grid.bin + 0.5) * (hi - lo) / 20.0')} AS bin_center,
    coalesce(n, 0) AS count FROM grid LEFT JOIN cnt ON cnt.symbol = grid.symbol AND cnt.bin = grid.bin"""))(
    lambda spark, sf: finalize(metrics.pnl_histogram(result(spark, sf).trades)))

register("pnl_moments", _bt_sql(f""" SELECT symbol, count(*) AS n, {r6('avg(pnl)')} AS mean,
  {r6('median(pnl)')} AS median, {r6('stddev_samp(pnl)')} AS std,
  {r6('CASE WHEN count(*) > 2 THEN coalesce(skewness(pnl), 0.0) ELSE 0.0 END')} AS skew FROM trades GROUP BY symbol"""))(
    lambda spark, sf: finalize(metrics.pnl_moments(result(spark, sf).trades)))


# Prices of two symbols hardly move here, so their bands round to one strike and the checks fail.
FLAT = ("5-LOW", "4-NOT SPECIFIED")
CALM = P.RunParams(hv_min=0.0, run_id="calm")
_FLAT_TICKS = ("SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq, 100.0 + o_totalprice / CASE WHEN o_orderpriority IN "
               f"{FLAT!r} THEN 100000000.0 ELSE 100000.0 END AS p, CAST(1 + o_orderkey % 100 AS DOUBLE) AS volume FROM orders")


def _flat_sql(body: str) -> str:
    bars = O.bars_sql(_FLAT_TICKS, 86400)
    return "WITH RECURSIVE " + O.indicator_ctes(bars, CALM.bb_window, CALM.trend_method) + "," + O.signal_ctes(CALM) + "," + O.position_ctes(CALM) + body


def flat_result(spark, sf):
    def build():
        t = ticks_orders(spark, sf)
        calm = lambda c: F.when(F.col("symbol").isin(*FLAT), F.lit(100.0) + (F.col(c) - 100.0) / 1000.0).otherwise(F.col(c))
        t = t.withColumns({c: calm(c) for c in ("open", "high", "low", "close", "vwap")})
        return BT.run_backtest(resample_bars(t, "Daily"), blackout_dates(spark), CALM, ["symbol"])
    return memo(spark, ("flat", sf), build)


register("strike_check", _flat_sql(" SELECT symbol, ts, idx, strikes_ok FROM res WHERE eligible"))(
    lambda spark, sf: finalize(flat_result(spark, sf).bars.filter("eligible").select("symbol", "ts", "idx", "strikes_ok")))

register("invalid_positions", _flat_sql(f""" SELECT symbol, idx AS entry_idx, ts AS entry_date,
  {_sqlcols(['bb_lower', 'bb_upper', 'short_put', 'long_put', 'short_call', 'long_call', 'net_credit'])}
  FROM res WHERE eligible AND NOT strikes_ok"""))(
    lambda spark, sf: finalize(positions.invalid_positions(flat_result(spark, sf).bars)))


# --- intraday (F2): bars from events, each timeframe's Bollinger window --------------
INTRADAY = {"hourly": "Hourly", "30min": "30-minute", "15min": "15-minute", "1min": "1-minute"}


def intraday_indicators(spark, sf, timeframe):
    def build():
        bars = resample_bars(ticks_events(spark, sf), timeframe)
        return I.compute_indicators(bars, ["symbol"], bb_window=P.bb_window(timeframe), trend_method="VWAP Slope",
                                    bar_seconds=P.timeframe_seconds(timeframe))
    return memo(spark, ("ind", timeframe, sf), build)


_H_COLS = ["bb_mid", "bb_upper", "bb_lower", "rsi", "atr", "plus_di", "minus_di", "adx", "vwap_sma20", "bb_width",
           "bb_tightening", "hv", "trend_up", "trend_down"]


def _intraday_sql(timeframe):
    bars = O.bars_sql(O.ticks_events_sql(), P.timeframe_seconds(timeframe))
    return "WITH RECURSIVE " + O.indicator_ctes(bars, P.bb_window(timeframe), "VWAP Slope") + " SELECT symbol, ts, idx, " + ", ".join(
        c if c in ("bb_tightening", "trend_up", "trend_down") else f"{r6(c)} AS {c}" for c in _H_COLS) + " FROM ind"


for _name, _timeframe in INTRADAY.items():
    register(f"indicators_{_name}", _intraday_sql(_timeframe))(
        lambda spark, sf, t=_timeframe: finalize(intraday_indicators(spark, sf, t).select("symbol", "ts", "idx", *_H_COLS)))


# --- many runs in one job ---------------------------------------------------------
GRID = (P.RunParams(run_id="run-0"), P.RunParams(hv_min=10.0, hv_max=50.0, run_id="wide"),
        P.RunParams(adx_exit_threshold=25, run_id="adx25"),
        P.RunParams(use_bias=True, days_before=3, days_after=2, wing_ext_pct=40.0, run_id="bias"),
        P.RunParams(use_bias=True, trend_method="ADX + DI", bias_strength=3.0, run_id="adxdi"),
        P.RunParams(trend_method="VWAP vs SMA20", use_bias=True, run_id="sma"))


def grid_result(spark, sf, runs=GRID):
    def build():
        return BT.run_grid(None, blackout_dates(spark), list(runs), ["symbol"],
                           indicators={P.BB_BASE_WINDOW: indicators(spark, sf)})
    return memo(spark, ("grid", sf, tuple(p.run_id for p in runs), runs), build)


def _grid_sql(runs=GRID):
    sel = ", ".join(c if c in _INTS else f"{r6(c)} AS {c}" for c in SUMMARY_COLS)
    return O.grid_with(list(runs)) + " " + " UNION ALL ".join(
        f"SELECT '{p.run_id}' AS run_id, symbol, {sel} FROM summary_{i}" for i, p in enumerate(runs))


register("backtest_grid", _grid_sql())(
    lambda spark, sf: finalize(grid_result(spark, sf).summary.select("run_id", "symbol", *SUMMARY_COLS)))
