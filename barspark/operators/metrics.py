"""Performance metrics over the trade ledger, as grouped aggregates per key.

All aggregates are partial (map-side combined); streaks use the running
counters the ledger already carries (gaps and islands), so no step collects a
key's trades into one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P


def streaks(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Longest run of 'win' and of 'loss' in trade order (anything else breaks a run).

    For the rows of one outcome, ``trade_no - count of that outcome so far`` is
    constant inside a run, so a run is a group: one partial aggregate over
    (key, outcome, run), then one over key."""
    keys = list(keys)
    o = F.col("outcome")
    island = F.when(o == "win", F.col("trade_no") - F.col("wins_so_far")) \
              .otherwise(F.col("trade_no") - F.col("losses_so_far"))
    runs = (trades.filter(o.isin("win", "loss"))
                  .groupBy(*keys, "outcome", island.alias("_island")).agg(F.count(F.lit(1)).alias("_len")))
    return runs.groupBy(*keys).agg(F.max(F.when(o == "win", F.col("_len"))).alias("win_streak"),
                                   F.max(F.when(o == "loss", F.col("_len"))).alias("loss_streak"))


def trade_stats(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    keys = list(keys)
    risk = (f"((least(short_put - long_put, long_call - short_call) - net_credit) * {P.CONTRACT_MULTIPLIER} "
            f"+ {4 * P.PER_LEG_FEE!r}D)")
    counts = ["count(1) AS trades"] + [f"count_if(outcome = '{o}') AS {a}" for o, a in (
        ("win", "wins"), ("loss", "losses"), ("breach", "breaches"), ("adx_exit", "adx_exits"),
        ("vwap_exit", "vwap_exits"), ("broke", "brokes"))]
    sums = ["sum(pnl) AS total_pnl", "avg(pnl) AS avg_pnl", "max(pnl) AS best_trade", "min(pnl) AS worst_trade",
            "avg(CASE WHEN outcome = 'win' THEN pnl END) AS _avg_win",
            "sum(CASE WHEN outcome = 'win' THEN pnl END) AS _tot_win",
            "avg(CASE WHEN outcome = 'loss' THEN pnl END) AS _avg_loss",
            "sum(CASE WHEN outcome = 'loss' THEN pnl END) AS _tot_loss",
            f"avg({risk}) AS avg_risk", f"sum({risk}) AS total_risk"]
    return trades.groupBy(*keys).agg(*[F.expr(e) for e in counts + sums])


def summary(trades: DataFrame, dd: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per key with every metric; keys without trades get zeros."""
    keys = list(keys)
    s = trade_stats(trades, keys)
    st = streaks(trades, keys)
    mdd = max_drawdown_from(dd, keys)
    base = dd.select(*keys).distinct()
    j = base.join(s, keys, "left").join(st, keys, "left").join(mdd, keys, "left")

    def z(c):
        return f"coalesce({c}, 0.0D)"

    def zi(c):
        return f"CAST(coalesce({c}, 0) AS BIGINT)"
    tw, tl = z("_tot_win"), f"abs({z('_tot_loss')})"
    aw, al = z("_avg_win"), f"abs({z('_avg_loss')})"
    n = zi("trades")
    cols = [f"{n} AS trades", *[f"{zi(c)} AS {c}" for c in ("wins", "losses", "breaches", "adx_exits",
                                                              "vwap_exits", "brokes")],
            f"CASE WHEN {n} > 0 THEN 100.0D * {zi('wins')} / {n} ELSE 0.0D END AS win_rate",
            f"{z('total_pnl')} AS total_pnl", f"{z('max_drawdown')} AS max_drawdown",
            f"{z('max_drawdown_pct')} AS max_drawdown_pct",
            f"CASE WHEN {tl} > 0 THEN {tw} / {tl} WHEN {tw} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0.0D END "
            f"AS profit_factor",
            f"{z('avg_pnl')} AS avg_pnl", f"{aw} AS avg_win", f"{al} AS avg_loss",
            f"CASE WHEN {al} > 0 AND {aw} > 0 THEN {aw} / {al} ELSE 0.0D END AS reward_risk_ratio",
            f"{z('best_trade')} AS best_trade", f"{z('worst_trade')} AS worst_trade",
            f"{zi('win_streak')} AS win_streak", f"{zi('loss_streak')} AS loss_streak",
            f"CASE WHEN {z('total_risk')} > 0 THEN 100.0D * {z('total_pnl')} / {z('total_risk')} ELSE 0.0D END "
            f"AS return_on_risk_pct",
            f"{tw} AS total_wins", f"{tl} AS total_losses", f"{z('avg_risk')} AS avg_risk",
            f"{z('total_risk')} AS total_risk"]
    return j.selectExpr(*[f"`{k}`" for k in keys], *cols)


def max_drawdown_from(dd: DataFrame, keys):
    from .ledger import max_drawdown
    return max_drawdown(dd, keys)


def monthly_breakdown(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """By exit month 'YYYY-MM': P&L, trade count and win rate."""
    keys = list(keys)
    return (trades.groupBy(*keys, F.date_format("expiry_date", "yyyy-MM").alias("month"))
                  .agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"),
                       (F.lit(100.0) * F.count_if(F.col("outcome") == "win") / F.count(F.lit(1))).alias("win_rate")))


def pnl_histogram(trades: DataFrame, keys: Sequence[str] = ("symbol",), bins: int = 20) -> DataFrame:
    """Equal-width histogram of pnl per key: bin centre and count, empty bins
    kept, last bin right-closed; one distinct value spans value +- 0.5."""
    keys = list(keys)
    rng = trades.groupBy(*keys).agg(F.min("pnl").alias("_lo0"), F.max("pnl").alias("_hi0"))
    same = F.col("_lo0") == F.col("_hi0")
    rng = rng.select(*keys, F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                     F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.least(F.floor((F.col("pnl") - F.col("_lo")) / step).cast("int"), F.lit(bins - 1))
    counts = trades.join(rng, keys).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*keys, "bin"], "left")
    centre = F.col("_lo") + (F.col("bin") + F.lit(0.5)) * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return out.select(*keys, "bin", centre.alias("bin_center"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def pnl_moments(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """mean, median, sample std, bias-corrected skew (0 when n <= 2). The median comes from counts
    by value over ranges, so no key's values meet in one buffer."""
    from .quantiles import exact_quantiles

    keys = list(keys)
    n = F.count(F.lit(1))
    g = trades.groupBy(*keys).agg(n.alias("n"), F.avg("pnl").alias("mean"),
                                  F.stddev_samp("pnl").alias("std"), F.skewness("pnl").alias("_g1"))
    nn = F.col("n").cast("double")
    adj = F.sqrt(nn * (nn - 1)) / (nn - 2)
    skew = F.when(F.col("n") > 2, F.coalesce(F.nanvl(F.col("_g1"), F.lit(0.0)), F.lit(0.0)) * adj).otherwise(F.lit(0.0))
    middle = exact_quantiles(trades, keys, "pnl").withColumnRenamed("q50", "median")
    same = None
    for k in keys:
        same = g[k].eqNullSafe(middle[k]) if same is None else same & g[k].eqNullSafe(middle[k])
    return g.join(middle, same, "left").select(*[g[k] for k in keys], "n", "mean", "median", "std", skew.alias("skew"))


def legacy_stats(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Extra statistics of the first application version: undefined ratios are
    NULL (not infinity), sums of wins/losses are clipped at zero."""
    keys = list(keys)
    o, pnl = F.col("outcome"), F.col("pnl")
    win, loss = o == "win", o == "loss"
    width = F.least(F.col("short_put") - F.col("long_put"), F.col("long_call") - F.col("short_call"))
    risk = (width - F.col("net_credit")) * 100.0 + 4 * P.PER_LEG_FEE
    g = trades.groupBy(*keys).agg(
        F.max(risk).alias("max_risk"), F.max(pnl).alias("high_pl"), F.min(pnl).alias("low_pl"),
        F.max(F.when(win, pnl)).alias("_bw"), F.min(F.when(loss, pnl)).alias("_wl"),
        F.count_if(win | loss).alias("expired"),
        F.sum(F.when(win, F.greatest(pnl, F.lit(0.0)))).alias("_ws"),
        F.sum(F.when(loss, F.least(pnl, F.lit(0.0)))).alias("_ls"),
        F.count_if(win).alias("_nw"), F.count_if(loss).alias("_nl"),
        F.avg(F.when(win, pnl)).alias("_aw"), F.avg(F.when(loss, pnl)).alias("_al"))
    ls = F.coalesce(F.col("_ls"), F.lit(0.0))
    pf = F.when(ls < 0, F.coalesce(F.col("_ws"), F.lit(0.0)) / F.abs(ls))
    rr = F.when((F.col("_nw") > 0) & (F.col("_nl") > 0) & (F.abs(F.col("_al")) > 0),
                F.col("_aw") / F.abs(F.col("_al")))
    return g.select(*keys, "max_risk", "high_pl", "low_pl", F.coalesce("_bw", F.lit(0.0)).alias("best_win"),
                    F.coalesce("_wl", F.lit(0.0)).alias("worst_loss"), "expired",
                    pf.alias("profit_factor_legacy"), rr.alias("reward_risk_legacy"))


def trades_per_day(trades: DataFrame, equity: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """trades / (days / 252) / 252 over the equity curve's date range."""
    keys = list(keys)
    span = equity.groupBy(*keys).agg(F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).alias("date_range_days"))
    n = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"))
    j = span.join(n, keys, "left").withColumn("trades", F.coalesce("trades", F.lit(0)))
    d = F.col("date_range_days")
    tpd = F.when(d > 0, F.col("trades") / (d / F.lit(252.0)) / F.lit(252.0)).otherwise(F.lit(0.0))
    return j.select(*keys, "trades", d.cast("long").alias("date_range_days"), tpd.alias("trades_per_day"))


def _top_desc(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def trades_display(trades: DataFrame, money: Sequence[str], keys: Sequence[str] = ("symbol",),
                   n: int = P.MAX_TABLE_ROWS) -> DataFrame:
    """Last ``n`` trades per key as display text: money '%.2f', minutes."""
    keys = list(keys)
    t = _top_desc(trades, keys, "trade_no", n)
    return t.select(*keys, F.date_format("entry_date", "yyyy-MM-dd HH:mm").alias("entry_date"),
                    F.date_format("expiry_date", "yyyy-MM-dd HH:mm").alias("expiry_date"),
                    *[F.format_string("%.2f", F.col(c)).alias(c) for c in money], "outcome")


def rejected_display(rejected: DataFrame, keys: Sequence[str] = ("symbol",), n: int = P.MAX_TABLE_ROWS) -> DataFrame:
    keys = list(keys)
    r = _top_desc(rejected, keys, "date", n)
    return r.select(*keys, F.date_format("date", "yyyy-MM-dd HH:mm").alias("date"), "reasons",
                    *[F.format_string("%.2f", F.col(c)).alias(c) for c in ("adx", "rsi", "hv")])


def trade_markers(trades: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Chart markers: entry at the entry bar's vwap, exit at the exit close.
    The ledger already carries the entry bar's vwap, so no join is needed."""
    return trades.select(*keys, "entry_date", F.col("entry_vwap"), "expiry_date",
                         F.col("expiry_close").alias("exit_close"), "outcome")


def pnl_rollup(trades: DataFrame, dims: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """P&L by ``dims`` with the subtotals of every prefix of them and the total, in one pass.

    Trades are summed by all dims first, so the expansion into grouping sets multiplies
    only those sums. ``level`` is the grouping id: a bit is 1 where the column is a total;
    a null of the data has the bit 0."""
    base = trades.groupBy(*dims).agg(F.sum(pnl).alias("_pnl"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col(pnl) > 0).alias("_w"))
    return base.rollup(*dims).agg(F.grouping_id().cast("bigint").alias("level"), F.sum("_pnl").alias("pnl"), F.sum("_n").alias("trades"), F.sum("_w").alias("wins"))
