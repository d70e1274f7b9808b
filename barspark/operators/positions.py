"""Iron-condor positions, exits and P&L as a bounded look-ahead window.

An entry never depends on open positions or cash, and a position lives at
most ``EXPIRY_MAX_BARS`` bars, so position i is a function of bars i-2 .. i+5.
The whole bar loop is therefore one window pass over halo segments (back 8,
ahead 5): leads for the exit scan, lags for the per-bar exit P&L that feeds
the equity curve. No self-join, no per-key task, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..plans import ordered

K = P.EXPIRY_MAX_BARS
FEES = 4 * P.PER_LEG_FEE


def condor_pnl(price: Column, sp: Column, lp: Column, sc: Column, lc: Column, credit: Column):
    """(pnl, outcome) at ``price``: inside the short strikes (inclusive) wins the
    credit; otherwise the full width of the breached side is lost."""
    win = (price >= sp) & (price <= sc)
    width = F.when(price > sc, lc - sc).otherwise(sp - lp)
    pnl = F.when(win, credit * P.CONTRACT_MULTIPLIER - FEES) \
           .otherwise(-(width - credit) * P.CONTRACT_MULTIPLIER - FEES)
    return pnl, F.when(win, F.lit("win")).otherwise(F.lit("loss"))


def _sql(v) -> str:
    """SQL text of a parameter: a column given by name, or a typed literal."""
    if isinstance(v, str):
        return f"`{v}`"
    if isinstance(v, bool):
        return "true" if v else "false"
    return f"CAST({float(v)!r} AS DOUBLE)"


def strikes_sql(use_bias, bias_strength, wing_ext_pct) -> dict[str, str]:
    """Short strikes (half-even rounding ``rint``) and wings as SQL expressions.
    Parameters may be Python values or names of per-run columns."""
    if isinstance(use_bias, bool) and not use_bias:
        sp, sc = "rint(bb_lower)", "rint(bb_upper)"
    else:
        ub, b = _sql(use_bias), f"CAST({_sql(bias_strength)} AS DOUBLE)"
        sp = (f"CASE WHEN {ub} AND trend_up THEN rint(bb_lower + 0.5D * {b}) "
              f"WHEN {ub} AND trend_down THEN rint(bb_lower - {b}) ELSE rint(bb_lower) END")
        sc = (f"CASE WHEN {ub} AND trend_up THEN rint(bb_upper + {b}) "
              f"WHEN {ub} AND trend_down THEN rint(bb_upper - 0.5D * {b}) ELSE rint(bb_upper) END")
    if isinstance(wing_ext_pct, str):
        wide = f"({P.DEFAULT_WING_WIDTH!r}D * (1.0D + greatest(CAST({_sql(wing_ext_pct)} AS DOUBLE), 0.0D) / 100.0D))"
    else:
        wide = f"{P.DEFAULT_WING_WIDTH * (1.0 + max(0.0, float(wing_ext_pct)) / 100.0)!r}D"
    base = f"{P.DEFAULT_WING_WIDTH!r}D"
    return {"short_put": sp, "short_call": sc,
            "put_wing": f"CASE WHEN trend_up AND _prev_down AND bb_tightening THEN {wide} ELSE {base} END",
            "call_wing": f"CASE WHEN trend_down AND _prev_up AND bb_tightening THEN {wide} ELSE {base} END"}


def resolve(sig: DataFrame, keys: Sequence[str] = ("symbol",), adx_exit_threshold: float = P.DEFAULT_ADX_EXIT,
            vwap_exit_k: float = P.DEFAULT_VWAP_K, use_bias: bool = False,
            bias_strength: float = P.DEFAULT_BIAS_STRENGTH, wing_ext_pct: float = P.DEFAULT_WING_EXT_PCT,
            seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    """Bars with eligibility -> bars with position and exit columns.

    Adds per bar: ``vwap_hit``, ``adx_hit``; for entry bars: strikes, credit,
    ``expiry_off``, ``exit_off``, ``outcome``, ``pnl``, ``exit_ts``,
    ``exit_close``, ``rule_exit``, ``strikes_ok``; and ``exit_pnl`` = P&L of
    all positions closing on this bar. Keeps ``_seg`` (home rows only).
    The expressions are generated as SQL text (one call per projection).
    """
    keys = list(keys)
    h = ordered.halo(sig, back=K + 3, fwd=K, seg_rows=seg_rows)
    W = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in [*keys, ordered.SEG])} ORDER BY `idx`)"
    h = h.selectExpr("*", f"lag(vwap_delta) {W} AS _vd_prev", f"coalesce(lag(trend_up) {W}, false) AS _prev_up",
                     f"coalesce(lag(trend_down) {W}, false) AS _prev_down")
    k_vwap, thr = _sql(vwap_exit_k), _sql(adx_exit_threshold)
    h = h.selectExpr(
        "*",
        f"coalesce(idx > 1 AND signum(vwap_delta) != 0 AND signum(_vd_prev) != 0 "
        f"AND signum(vwap_delta) != signum(_vd_prev) AND abs(close - vwap) >= {k_vwap} * (bb_upper - bb_mid) "
        f"AND ((vwap_delta > 0 AND close > vwap) OR (vwap_delta < 0 AND close < vwap)), false) AS vwap_hit",
        f"coalesce(adx >= {thr}, false) AS adx_hit",
        "weekday(ts) = 4 AS _fri",
        *[f"{e} AS {n}" for n, e in strikes_sql(use_bias, bias_strength, wing_ext_pct).items()])
    leads = []
    for k in range(0, K + 1):
        leads += [f"lead(idx, {k}) {W} AS _i{k}", f"lead(_fri, {k}) {W} AS _f{k}",
                  f"lead(close, {k}) {W} AS _c{k}", f"lead(ts, {k}) {W} AS _t{k}"]
        if k:
            leads += [f"lead(adx_hit, {k}) {W} AS _a{k}", f"lead(vwap_hit, {k}) {W} AS _v{k}"]
    h = h.selectExpr("*", "rint(short_put - put_wing) AS long_put", "rint(short_call + call_wing) AS long_call",
                     f"{P.DEFAULT_CREDIT_MULTIPLIER!r}D * least(call_wing, put_wing) AS net_credit", *leads)
    # expiry: first Friday among bars i .. i+5 that exist, else the last of them
    last_k = "CASE " + " ".join(f"WHEN _i{k} IS NOT NULL THEN {k}" for k in range(K, 0, -1)) + " ELSE 0 END"
    expiry = "CASE " + " ".join(f"WHEN coalesce(_f{k}, false) THEN {k}" for k in range(0, K + 1)) + f" ELSE {last_k} END"
    h = h.selectExpr("*", f"{expiry} AS expiry_off")

    def reason(k):
        return (f"CASE WHEN coalesce(_c{k} < long_put OR _c{k} > long_call, false) THEN 'broke' "
                f"WHEN coalesce(_c{k} < short_put OR _c{k} > short_call, false) THEN 'breach' "
                f"WHEN _a{k} THEN 'adx_exit' WHEN _v{k} THEN 'vwap_exit' END")
    live = [f"{k} < expiry_off AND ({reason(k)}) IS NOT NULL" for k in range(1, K + 1)]
    rk = "CASE " + " ".join(f"WHEN {c} THEN {k}" for k, c in zip(range(1, K + 1), live)) + " END"
    rr = "CASE " + " ".join(f"WHEN {c} THEN {reason(k)}" for k, c in zip(range(1, K + 1), live)) + " END"
    h = h.selectExpr("*", f"{rk} AS _rk", f"{rr} AS _rr")
    h = h.selectExpr("*", "CASE WHEN _rk IS NOT NULL THEN _rk WHEN expiry_off > 0 THEN expiry_off END AS exit_off")
    pick_c = "CASE exit_off " + " ".join(f"WHEN {k} THEN _c{k}" for k in range(1, K + 1)) + " END"
    pick_t = "CASE exit_off " + " ".join(f"WHEN {k} THEN _t{k}" for k in range(1, K + 1)) + " END"
    h = h.selectExpr("*", f"{pick_c} AS exit_close", f"{pick_t} AS exit_ts",
                     "coalesce(long_put < short_put AND short_put < short_call AND short_call < long_call "
                     "AND net_credit > 0, false) AS strikes_ok")
    pnl, result = condor_pnl(*[F.col(c) for c in ("exit_close", "short_put", "long_put", "short_call", "long_call", "net_credit")])
    closed = F.col("exit_off").isNotNull()
    h = h.select("*", F.when(closed, pnl).alias("pnl"), F.coalesce("_rr", F.when(closed, result)).alias("outcome"),
                 F.col("_rk").isNotNull().alias("rule_exit"))
    closes = "eligible AND strikes_ok AND exit_off IS NOT NULL"
    h = h.selectExpr("*", f"CASE WHEN {closes} THEN pnl END AS _closing_pnl",
                     f"CASE WHEN {closes} THEN exit_off END AS _closing_off")
    exit_pnl = " + ".join(["0.0D"] + [f"coalesce(CASE WHEN lag(_closing_off, {k}) {W} = {k} THEN "
                                      f"lag(_closing_pnl, {k}) {W} END, 0.0D)" for k in range(1, K + 1)])
    h = h.selectExpr("*", f"{exit_pnl} AS exit_pnl")
    h = ordered.home(h)
    drop = [c for c in h.columns if c.startswith("_") and c != ordered.SEG]
    return h.drop(*drop)


def positions(res: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Every valid entry (eligible bar with well-ordered strikes)."""
    return (res.filter(F.col("eligible") & F.col("strikes_ok"))
               .select(*keys, F.col("idx").alias("entry_idx"), F.col("ts").alias("entry_date"),
                       (F.col("idx") + F.col("expiry_off")).alias("expiry_idx"),
                       "short_put", "long_put", "short_call", "long_call", "net_credit"))


def unresolved_positions(res: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Positions whose expiry bar is the entry bar: they never close (no trade)."""
    return positions(res.filter(F.col("expiry_off") == 0), keys)


def invalid_positions(res: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Eligible bars whose strikes are not strictly ordered or credit <= 0
    (the original aborts the run there; here they are set aside)."""
    return (res.filter(F.col("eligible") & ~F.col("strikes_ok"))
               .select(*keys, F.col("idx").alias("entry_idx"), F.col("ts").alias("entry_date"),
                       "bb_lower", "bb_upper", "short_put", "long_put", "short_call", "long_call", "net_credit"))


def trades(res: DataFrame, keys: Sequence[str] = ("symbol",), seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    """Closed positions in exit order (exit bar, rule exits before expiries,
    entry bar) with the running ``cum_pnl``."""
    keys = list(keys)
    t = (res.filter(F.col("eligible") & F.col("strikes_ok") & F.col("exit_off").isNotNull())
            .select(*keys,
                    F.col("ts").alias("entry_date"), F.col("exit_ts").alias("expiry_date"),
                    "short_put", "long_put", "short_call", "long_call", "net_credit",
                    F.col("exit_close").alias("expiry_close"), "pnl", "outcome",
                    F.col("vwap").alias("entry_vwap"), F.col("idx").alias("entry_idx"), (F.col("idx") + F.col("exit_off")).alias("exit_idx"),
                    (~F.col("rule_exit")).alias("is_expiry")))
    t = t.withColumn("_tseg", F.floor(F.col("exit_idx") / F.lit(int(seg_rows))))
    order = ["exit_idx", "is_expiry", "entry_idx"]
    return _trade_running(t, keys, order)


def _trade_running(t: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    t = t.withColumn("_one", F.lit(1)).withColumn("_win", (F.col("outcome") == "win").cast("int")) \
         .withColumn("_loss", (F.col("outcome") == "loss").cast("int"))
    t = ordered.running(t, keys, order, {"cum_pnl": "pnl", "trade_no": "_one",
                                         "wins_so_far": "_win", "losses_so_far": "_loss"}, seg="_tseg")
    return t.drop("_one", "_win", "_loss", "_tseg")
