"""Reference SQL (DuckDB dialect) for the correctness check.

Written independently of the Spark plans: sequential semantics, a recursive
CTE for the exponentially weighted means, plain windows for everything else.
Doubles are compared after ``r6`` (x*1e6 rounded half away from zero, /1e6),
which the Spark side applies identically.
"""

from __future__ import annotations

from . import params as P
from .sources.fixtures import BLACKOUT_DATES

ALPHA = 1.0 / P.RSI_PERIOD
DEC = 1.0 - ALPHA


def dbl(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def r6(e: str, digits: int = 6) -> str:
    """Same comparison rounding as the Spark side (offset threshold)."""
    m = f"{10 ** digits}.0"
    return f"(round(CAST(({e}) AS DOUBLE) * {m} + CAST(0.2345678 AS DOUBLE)) / {m} + 0.0)"


def ticks_orders_sql() -> str:
    return ("SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq, "
            "100.0 + o_totalprice / 100000.0 AS p, CAST(1 + o_orderkey % 100 AS DOUBLE) AS volume FROM orders")


def ticks_events_sql() -> str:
    return ("SELECT event_type AS symbol, ts, event_id AS seq, 100.0 + value / 100.0 AS p, "
            "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events")


def bars_sql(ticks: str, seconds: int, vwap: bool = True) -> str:
    v = "avg(p) AS vwap, " if vwap else ""
    nn = "vwap IS NOT NULL AND " if vwap else ""
    return f"""SELECT * FROM (SELECT symbol, bucket AS ts,
        first(p ORDER BY ts, seq) AS open, max(p) AS high, min(p) AS low,
        first(p ORDER BY ts DESC, seq DESC) AS close, {v}coalesce(sum(volume), 0.0) AS volume
      FROM (SELECT *, time_bucket(INTERVAL '{int(seconds)} seconds', ts) AS bucket FROM ({ticks}) t0) t1
      GROUP BY symbol, bucket) t2
    WHERE {nn}open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"""


def _ewm_step(y: str, c: str, x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN {y} WHEN {y} IS NULL THEN {x} "
            f"ELSE (pow({dbl(DEC)}, {c} + 1) * {y} + {dbl(ALPHA)} * {x}) / (pow({dbl(DEC)}, {c} + 1) + {dbl(ALPHA)}) END")


def _ewm_count(y: str, c: str, x: str) -> str:
    return f"CASE WHEN {x} IS NULL AND {y} IS NOT NULL THEN {c} + 1 ELSE 0 END"


def indicator_ctes(bars: str, bb_window: int = P.BB_BASE_WINDOW, trend: str = P.DEFAULT_TREND_METHOD) -> str:
    """CTEs ib .. ind; ``ind`` has bars + indicators (+ trend flags) per (symbol, idx)."""
    w = int(bb_window)
    ew_src = [("ag", "cg", "gain"), ("al", "cl", "loss"), ("atr", "ct", "tr"), ("pde", "cp", "pdm"), ("mde", "cm", "mdm")]
    seed = ", ".join(f"{x} AS {y}, 0 AS {c}" for y, c, x in ew_src)
    rec = ", ".join(f"{_ewm_step('e.' + y, 'e.' + c, 'n.' + x)}, {_ewm_count('e.' + y, 'e.' + c, 'n.' + x)}"
                    for y, c, x in ew_src)
    if trend == "VWAP Slope":
        tu, td = "vwap_delta > 0", "vwap_delta < 0"
    elif trend == "VWAP vs SMA20":
        tu, td = "vwap > vwap_sma20", "vwap < vwap_sma20"
    elif trend == "ADX + DI":
        tu, td = "plus_di > minus_di AND adx > 20", "minus_di > plus_di AND adx > 20"
    else:
        tu, td = "false", "false"
    return f"""
ib AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx FROM ({bars}) b),
l1 AS MATERIALIZED (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
        lag(vwap) OVER w AS pvw FROM ib WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
l2 AS MATERIALIZED (SELECT *,
        CASE WHEN close - pc IS NOT NULL THEN greatest(close - pc, 0.0) END AS gain,
        CASE WHEN close - pc IS NOT NULL THEN -least(close - pc, 0.0) END AS loss,
        CASE WHEN high - ph IS NULL THEN NULL WHEN high - ph > -(low - pl) AND high - ph > 0 THEN high - ph
             ELSE {dbl(0)} END AS pdm,
        CASE WHEN -(low - pl) IS NULL THEN NULL WHEN -(low - pl) > high - ph AND -(low - pl) > 0 THEN -(low - pl)
             ELSE {dbl(0)} END AS mdm,
        greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
        ln(close) - ln(pc) AS lr,
        vwap - pvw AS vwap_delta
      FROM l1),
l3 AS MATERIALIZED (SELECT *,
        CASE WHEN count(vwap) OVER wb = {w} THEN avg(vwap) OVER wb END AS bb_mid,
        CASE WHEN count(vwap) OVER wb = {w} THEN stddev_pop(vwap) OVER wb END AS bstd,
        CASE WHEN count(vwap) OVER ws = {P.VWAP_SMA_WINDOW} THEN avg(vwap) OVER ws END AS vwap_sma20,
        CASE WHEN count(lr) OVER wh = {P.HV_WINDOW} THEN stddev_pop(lr) OVER wh * sqrt({P.ANNUALIZATION_FACTOR}) * 100.0 END
          AS hv_raw
      FROM l2 WINDOW
        wb AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW),
        ws AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {P.VWAP_SMA_WINDOW - 1} PRECEDING AND CURRENT ROW),
        wh AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {P.HV_WINDOW - 1} PRECEDING AND CURRENT ROW)),
l4 AS MATERIALIZED (SELECT *, bb_mid + 2.0 * bstd AS bb_upper, bb_mid - 2.0 * bstd AS bb_lower,
        (bb_mid + 2.0 * bstd) - (bb_mid - 2.0 * bstd) AS bb_width FROM l3),
l5 AS MATERIALIZED (SELECT *, coalesce(bb_width < lag(bb_width) OVER w AND bb_width <
          CASE WHEN count(bb_width) OVER wt >= {P.BB_TIGHTENING_MIN_PERIODS} THEN median(bb_width) OVER wt END, false)
          AS bb_tightening
      FROM l4 WINDOW w AS (PARTITION BY symbol ORDER BY idx),
        wt AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {P.BB_TIGHTENING_WINDOW - 1} PRECEDING AND CURRENT ROW)),
ew AS (SELECT symbol, idx, {seed} FROM l5 WHERE idx = 0
       UNION ALL
       SELECT n.symbol, n.idx, {rec} FROM ew e JOIN l5 n ON n.symbol = e.symbol AND n.idx = e.idx + 1),
l6 AS MATERIALIZED (SELECT l5.*, ew.atr,
        100.0 - 100.0 / (1 + ew.ag / nullif(ew.al, 0)) AS rsi_raw,
        100.0 * (ew.pde / nullif(ew.atr, 0)) AS plus_di,
        100.0 * (ew.mde / nullif(ew.atr, 0)) AS minus_di
      FROM l5 JOIN ew USING (symbol, idx)),
l7 AS MATERIALIZED (SELECT *, abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) * 100.0 AS dx FROM l6),
ax AS (SELECT symbol, idx, dx AS y, 0 AS c FROM l7 WHERE idx = 0
       UNION ALL
       SELECT n.symbol, n.idx, {_ewm_step('e.y', 'e.c', 'n.dx')}, {_ewm_count('e.y', 'e.c', 'n.dx')}
       FROM ax e JOIN l7 n ON n.symbol = e.symbol AND n.idx = e.idx + 1),
l8 AS MATERIALIZED (SELECT l7.*, ax.y AS adx_raw FROM l7 JOIN ax USING (symbol, idx)),
ind0 AS MATERIALIZED (SELECT *,
        coalesce(rsi_raw, first_value(rsi_raw IGNORE NULLS) OVER wf, last_value(rsi_raw IGNORE NULLS) OVER wp) AS rsi,
        coalesce(adx_raw, first_value(adx_raw IGNORE NULLS) OVER wf, last_value(adx_raw IGNORE NULLS) OVER wp) AS adx,
        coalesce(hv_raw, first_value(hv_raw IGNORE NULLS) OVER wf, last_value(hv_raw IGNORE NULLS) OVER wp) AS hv
      FROM l8 WINDOW
        wf AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        wp AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ind AS MATERIALIZED (SELECT *, coalesce({tu}, false) AS trend_up, coalesce({td}, false) AS trend_down FROM ind0)
"""


def blackout_values(dates=None) -> str:
    ds = BLACKOUT_DATES if dates is None else dates
    return "SELECT event_date FROM (VALUES " + ", ".join(f"(DATE '{d}')" for d in ds) + ") v(event_date)"


def _trend_sql(trend: str) -> tuple[str, str]:
    if trend == "VWAP Slope":
        return "vwap_delta > 0", "vwap_delta < 0"
    if trend == "VWAP vs SMA20":
        return "vwap > vwap_sma20", "vwap < vwap_sma20"
    if trend == "ADX + DI":
        return "plus_di > minus_di AND adx > 20", "minus_di > plus_di AND adx > 20"
    return "false", "false"


def signal_ctes(p: P.RunParams = P.RunParams(), blackout: bool = True, own_trend: bool = False) -> str:
    """``own_trend``: recompute the trend flags for this run's method (grids
    share one indicator chain across runs with different methods)."""
    src = "ind"
    if own_trend:
        tu, td = _trend_sql(p.trend_method)
        src = (f"(SELECT * EXCLUDE (trend_up, trend_down), coalesce({tu}, false) AS trend_up, "
               f"coalesce({td}, false) AS trend_down FROM ind) ind")
    if blackout:
        bo = (f"EXISTS (SELECT 1 FROM ({blackout_values()}) e WHERE CAST(ind.ts AS DATE) BETWEEN "
              f"e.event_date - INTERVAL {int(p.days_before)} DAY AND e.event_date + INTERVAL {int(p.days_after)} DAY)")
    else:
        bo = "false"
    return f"""
sig0 AS MATERIALIZED (SELECT ind.*, {bo} AS blackout,
        coalesce(adx < {P.ADX_ENTRY_THRESHOLD}, false) AS cond_adx,
        coalesce(rsi >= {P.RSI_LOWER_BOUND} AND rsi <= {P.RSI_UPPER_BOUND}, false) AS cond_rsi,
        coalesce(hv >= {dbl(p.hv_min)} AND hv <= {dbl(p.hv_max)}, false) AS cond_hv FROM {src}),
sig AS MATERIALIZED (SELECT *, cond_adx AND cond_rsi AND cond_hv AND NOT blackout AS eligible FROM sig0)
"""


def position_ctes(p: P.RunParams = P.RunParams()) -> str:
    K = P.EXPIRY_MAX_BARS
    ext = 1.0 + max(0.0, float(p.wing_ext_pct)) / 100.0
    wide = dbl(P.DEFAULT_WING_WIDTH * ext)
    base = dbl(P.DEFAULT_WING_WIDTH)
    if p.use_bias:
        b = float(p.bias_strength)
        sp = (f"CASE WHEN trend_up THEN round_even(bb_lower + {dbl(0.5 * b)}, 0) WHEN trend_down THEN "
              f"round_even(bb_lower - {dbl(b)}, 0) ELSE round_even(bb_lower, 0) END")
        sc = (f"CASE WHEN trend_up THEN round_even(bb_upper + {dbl(b)}, 0) WHEN trend_down THEN "
              f"round_even(bb_upper - {dbl(0.5 * b)}, 0) ELSE round_even(bb_upper, 0) END")
    else:
        sp, sc = "round_even(bb_lower, 0)", "round_even(bb_upper, 0)"
    leads = ", ".join(
        f"lead(idx, {k}) OVER w AS i{k}, coalesce(isodow(lead(ts, {k}) OVER w) = 5, false) AS f{k}, "
        f"lead(close, {k}) OVER w AS c{k}, lead(ts, {k}) OVER w AS t{k}"
        + (f", lead(adx_hit, {k}) OVER w AS a{k}, lead(vwap_hit, {k}) OVER w AS v{k}" if k else "")
        for k in range(0, K + 1))
    last_k = "CASE " + " ".join(f"WHEN i{k} IS NOT NULL THEN {k}" for k in range(K, 0, -1)) + " ELSE 0 END"
    expiry = "CASE " + " ".join(f"WHEN f{k} THEN {k}" for k in range(0, K + 1)) + f" ELSE {last_k} END"

    def reason(k):
        return (f"CASE WHEN coalesce(c{k} < long_put OR c{k} > long_call, false) THEN 'broke' "
                f"WHEN coalesce(c{k} < short_put OR c{k} > short_call, false) THEN 'breach' "
                f"WHEN a{k} THEN 'adx_exit' WHEN v{k} THEN 'vwap_exit' END")
    rk = "CASE " + " ".join(f"WHEN {k} < expiry_off AND ({reason(k)}) IS NOT NULL THEN {k}"
                            for k in range(1, K + 1)) + " END"
    rr = "CASE " + " ".join(f"WHEN {k} < expiry_off AND ({reason(k)}) IS NOT NULL THEN {reason(k)}"
                            for k in range(1, K + 1)) + " END"
    pick_c = "CASE exit_off " + " ".join(f"WHEN {k} THEN c{k}" for k in range(1, K + 1)) + " END"
    pick_t = "CASE exit_off " + " ".join(f"WHEN {k} THEN t{k}" for k in range(1, K + 1)) + " END"
    fees = dbl(4 * P.PER_LEG_FEE)
    exit_pnl = " + ".join(
        f"coalesce(CASE WHEN lag(closing_off, {k}) OVER w = {k} THEN lag(closing_pnl, {k}) OVER w END, 0.0)"
        for k in range(1, K + 1))
    return f"""
p1 AS MATERIALIZED (SELECT *, lag(vwap_delta) OVER w AS vdp,
        coalesce(lag(trend_up) OVER w, false) AS prev_up, coalesce(lag(trend_down) OVER w, false) AS prev_down
      FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
p2 AS MATERIALIZED (SELECT *,
        coalesce(idx > 1 AND sign(vwap_delta) != 0 AND sign(vdp) != 0 AND sign(vwap_delta) != sign(vdp)
                 AND abs(close - vwap) >= {dbl(p.vwap_exit_k)} * (bb_upper - bb_mid)
                 AND ((vwap_delta > 0 AND close > vwap) OR (vwap_delta < 0 AND close < vwap)), false) AS vwap_hit,
        coalesce(adx >= {dbl(p.adx_exit_threshold)}, false) AS adx_hit,
        {sp} AS short_put, {sc} AS short_call,
        CASE WHEN trend_up AND prev_down AND bb_tightening THEN {wide} ELSE {base} END AS put_wing,
        CASE WHEN trend_down AND prev_up AND bb_tightening THEN {wide} ELSE {base} END AS call_wing
      FROM p1),
p3 AS MATERIALIZED (SELECT *, round_even(short_put - put_wing, 0) AS long_put,
        round_even(short_call + call_wing, 0) AS long_call,
        {dbl(P.DEFAULT_CREDIT_MULTIPLIER)} * least(call_wing, put_wing) AS net_credit, {leads}
      FROM p2 WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
p4 AS MATERIALIZED (SELECT *, CAST({expiry} AS BIGINT) AS expiry_off FROM p3),
p5 AS MATERIALIZED (SELECT *, {rk} AS rk, {rr} AS rr FROM p4),
p6 AS MATERIALIZED (SELECT *, CAST(CASE WHEN rk IS NOT NULL THEN rk WHEN expiry_off > 0 THEN expiry_off END AS BIGINT)
        AS exit_off
      FROM p5),
p7 AS MATERIALIZED (SELECT *, {pick_c} AS exit_close, {pick_t} AS exit_ts,
        coalesce(long_put < short_put AND short_put < short_call AND short_call < long_call AND net_credit > 0, false)
          AS strikes_ok FROM p6),
p8 AS MATERIALIZED (SELECT *,
        CASE WHEN exit_off IS NOT NULL THEN
          CASE WHEN exit_close >= short_put AND exit_close <= short_call THEN net_credit * 100 - {fees}
               ELSE -((CASE WHEN exit_close > short_call THEN long_call - short_call ELSE short_put - long_put END)
                      - net_credit) * 100 - {fees} END END AS pnl,
        CASE WHEN rr IS NOT NULL THEN rr WHEN exit_off IS NOT NULL THEN
          CASE WHEN exit_close >= short_put AND exit_close <= short_call THEN 'win' ELSE 'loss' END END AS outcome,
        rk IS NOT NULL AS rule_exit
      FROM p7),
p9 AS MATERIALIZED (SELECT *,
        CASE WHEN eligible AND strikes_ok AND exit_off IS NOT NULL THEN pnl END AS closing_pnl,
        CASE WHEN eligible AND strikes_ok AND exit_off IS NOT NULL THEN exit_off END AS closing_off FROM p8),
res AS MATERIALIZED (SELECT *, {exit_pnl} AS exit_pnl FROM p9 WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
trades AS MATERIALIZED (SELECT symbol, ts AS entry_date, exit_ts AS expiry_date, short_put, long_put, short_call,
        long_call, net_credit, exit_close AS expiry_close, pnl, outcome, idx AS entry_idx, idx + exit_off AS exit_idx,
        NOT rule_exit AS is_expiry,
        sum(pnl) OVER (PARTITION BY symbol ORDER BY idx + exit_off, NOT rule_exit, idx
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pnl,
        row_number() OVER (PARTITION BY symbol ORDER BY idx + exit_off, NOT rule_exit, idx) AS trade_no
      FROM res WHERE eligible AND strikes_ok AND exit_off IS NOT NULL),
equity AS MATERIALIZED (SELECT symbol, idx, ts, sum(exit_pnl) OVER (PARTITION BY symbol ORDER BY idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cash FROM res),
dd AS MATERIALIZED (SELECT *, max(cash) OVER (PARTITION BY symbol ORDER BY idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM equity),
dd2 AS MATERIALIZED (SELECT *, peak - cash AS drawdown FROM dd)
"""


def daily_backtest_with(p: P.RunParams = P.RunParams(), blackout: bool = True) -> str:
    bars = bars_sql(ticks_orders_sql(), 86400)
    return ("WITH RECURSIVE " + indicator_ctes(bars, p.bb_window, p.trend_method) + ","
            + signal_ctes(p, blackout) + "," + position_ctes(p))


def daily_indicators_with(trend: str = P.DEFAULT_TREND_METHOD, bb_window: int = P.BB_BASE_WINDOW) -> str:
    return "WITH RECURSIVE " + indicator_ctes(bars_sql(ticks_orders_sql(), 86400), bb_window, trend)


def summary_select() -> str:
    """Summary per symbol from the CTEs ``trades`` and ``dd2``."""
    return f"""
, ts_ AS (SELECT symbol, count(*) AS trades,
        count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses,
        count(*) FILTER (WHERE outcome = 'breach') AS breaches, count(*) FILTER (WHERE outcome = 'adx_exit') AS adx_exits,
        count(*) FILTER (WHERE outcome = 'vwap_exit') AS vwap_exits, count(*) FILTER (WHERE outcome = 'broke') AS brokes,
        sum(pnl) AS total_pnl, avg(pnl) AS avg_pnl, max(pnl) AS best_trade, min(pnl) AS worst_trade,
        avg(pnl) FILTER (WHERE outcome = 'win') AS aw, sum(pnl) FILTER (WHERE outcome = 'win') AS tw,
        avg(pnl) FILTER (WHERE outcome = 'loss') AS al, sum(pnl) FILTER (WHERE outcome = 'loss') AS tl,
        avg((least(short_put - long_put, long_call - short_call) - net_credit) * 100 + {dbl(4 * P.PER_LEG_FEE)}) AS avg_risk,
        sum((least(short_put - long_put, long_call - short_call) - net_credit) * 100 + {dbl(4 * P.PER_LEG_FEE)}) AS total_risk
      FROM trades GROUP BY symbol),
isl AS (SELECT symbol, outcome, trade_no - row_number() OVER (PARTITION BY symbol, outcome ORDER BY trade_no) AS g
      FROM trades WHERE outcome IN ('win', 'loss')),
stk AS (SELECT symbol, max(n) FILTER (WHERE outcome = 'win') AS win_streak, max(n) FILTER (WHERE outcome = 'loss') AS loss_streak
      FROM (SELECT symbol, outcome, g, count(*) AS n FROM isl GROUP BY symbol, outcome, g) x GROUP BY symbol),
mdd AS (SELECT symbol, max(drawdown) AS max_drawdown, arg_max(peak, (drawdown, -idx)) AS peak_at FROM dd2 GROUP BY symbol),
s0 AS (SELECT k.symbol, coalesce(t.trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses,
        coalesce(breaches, 0) AS breaches, coalesce(adx_exits, 0) AS adx_exits, coalesce(vwap_exits, 0) AS vwap_exits,
        coalesce(brokes, 0) AS brokes, coalesce(total_pnl, 0.0) AS total_pnl, coalesce(avg_pnl, 0.0) AS avg_pnl,
        coalesce(best_trade, 0.0) AS best_trade, coalesce(worst_trade, 0.0) AS worst_trade,
        coalesce(aw, 0.0) AS avg_win, coalesce(tw, 0.0) AS total_wins, abs(coalesce(al, 0.0)) AS avg_loss,
        abs(coalesce(tl, 0.0)) AS total_losses, coalesce(avg_risk, 0.0) AS avg_risk, coalesce(total_risk, 0.0) AS total_risk,
        coalesce(win_streak, 0) AS win_streak, coalesce(loss_streak, 0) AS loss_streak,
        coalesce(max_drawdown, 0.0) AS max_drawdown,
        CASE WHEN max_drawdown > 0 AND peak_at != 0 THEN 100.0 * max_drawdown / peak_at ELSE 0.0 END AS max_drawdown_pct
      FROM (SELECT DISTINCT symbol FROM dd2) k LEFT JOIN ts_ t USING (symbol) LEFT JOIN stk USING (symbol)
        LEFT JOIN mdd USING (symbol)),
summary AS (SELECT *,
        CASE WHEN trades > 0 THEN 100.0 * wins / trades ELSE 0.0 END AS win_rate,
        CASE WHEN total_losses > 0 THEN total_wins / total_losses WHEN total_wins > 0 THEN CAST('inf' AS DOUBLE)
             ELSE 0.0 END AS profit_factor,
        CASE WHEN avg_loss > 0 AND avg_win > 0 THEN avg_win / avg_loss ELSE 0.0 END AS reward_risk_ratio,
        CASE WHEN total_risk > 0 THEN 100.0 * total_pnl / total_risk ELSE 0.0 END AS return_on_risk_pct
      FROM s0)
"""


_PER_RUN_CTES = ["sig0", "sig", "p1", "p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9", "res", "equity", "dd2", "dd",
                 "ts_", "isl", "stk", "mdd", "s0", "summary"]


def suffix_ctes(sql: str, sfx: str) -> str:
    """Rename the per-run CTEs of ``signal_ctes + position_ctes (+ summary_select)``
    so several runs can share one WITH clause. ``trades`` is also a column name,
    so only its CTE definition and FROM/JOIN uses are renamed."""
    import re
    for n in _PER_RUN_CTES:
        sql = re.sub(rf"(?<![\w.]){re.escape(n)}(?![\w])(?!\s*\()", n + sfx, sql)
    sql = re.sub(r"\btrades AS MATERIALIZED", f"trades{sfx} AS MATERIALIZED", sql)
    sql = re.sub(r"\b(FROM|JOIN) trades\b", rf"\1 trades{sfx}", sql)
    return sql


def grid_with(runs, bars: str | None = None) -> str:
    """One WITH clause: shared indicators, then signals/positions/summary per run."""
    bars = bars or bars_sql(ticks_orders_sql(), 86400)
    bbs = {p.bb_window for p in runs}
    assert len(bbs) == 1, "the oracle shares one indicator chain"
    body = ",".join(suffix_ctes(signal_ctes(p, own_trend=True) + "," + position_ctes(p) + summary_select(), f"_{i}")
                    for i, p in enumerate(runs))
    return "WITH RECURSIVE " + indicator_ctes(bars, bbs.pop(), "none") + "," + body
