"""The whole backtest: bars -> indicators -> signals -> positions -> ledger -> metrics.

One lazy plan per output table. The resolved bar frame is persisted because
four outputs read it (trades, equity, rejections, summary).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..plans import ordered
from ..session import cut_lineage
from . import indicators as I
from . import ledger, metrics, positions, signals


@dataclass
class BacktestResult:
    bars: DataFrame          # indicators + signals + position columns, per bar
    trades: DataFrame
    equity: DataFrame
    drawdown: DataFrame
    rejected: DataFrame
    summary: DataFrame
    keys: tuple

    def unresolved(self) -> DataFrame:
        return positions.unresolved_positions(self.bars, self.keys)

    def invalid(self) -> DataFrame:
        return positions.invalid_positions(self.bars, self.keys)


def resolve_bars(bars: DataFrame, events: DataFrame | None = None, p: P.RunParams = P.RunParams(),
                 keys: Sequence[str] = ("symbol",), bar_seconds: int = P.SMALLEST_BAR_SECONDS,
                 seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    keys = list(keys)
    ind = I.compute_indicators(bars, keys, bb_window=p.bb_window, trend_method=None,
                               bar_seconds=bar_seconds, seg_rows=seg_rows)
    return resolve_indicators(ind, events, p, keys, seg_rows)


def resolve_indicators(ind: DataFrame, events: DataFrame | None = None, p: P.RunParams = P.RunParams(),
                       keys: Sequence[str] = ("symbol",), seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    """Indicators (without trend flags) -> resolved bars for one parameter set."""
    keys = list(keys)
    ind = I.trend_flags(ind, p.trend_method)
    sig = signals.with_blackout(ind, events, p.days_before, p.days_after)
    sig = signals.with_eligibility(sig, p.hv_min, p.hv_max)
    return positions.resolve(sig, keys, p.adx_exit_threshold, p.vwap_exit_k, p.use_bias, p.bias_strength,
                             p.wing_ext_pct, seg_rows=seg_rows)


def run_backtest(bars: DataFrame, events: DataFrame | None = None, p: P.RunParams = P.RunParams(),
                 keys: Sequence[str] = ("symbol",), bar_seconds: int = P.SMALLEST_BAR_SECONDS,
                 seg_rows: int = ordered.SEG_ROWS, persist: bool = True) -> BacktestResult:
    keys = list(keys)
    res = resolve_bars(bars, events, p, keys, bar_seconds, seg_rows)
    return ledger_outputs(res, keys, seg_rows, persist)


def ledger_outputs(res: DataFrame, keys: Sequence[str] = ("symbol",), seg_rows: int = ordered.SEG_ROWS,
                   persist: bool = True) -> BacktestResult:
    keys = list(keys)
    if persist:
        res = cut_lineage(res)
    tr = positions.trades(res, keys, seg_rows=seg_rows)
    if persist:
        tr = cut_lineage(tr)
    eq = ledger.equity_curve(res, keys)
    dd = ledger.drawdown_series(eq, keys)
    rej = signals.rejections(res, keys)
    summ = metrics.summary(tr, dd, keys)
    return BacktestResult(res, tr, eq, dd, rej, summ, tuple(keys))


def equity_view(eq: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return eq.select(*keys, F.col("ts").alias("date"), "cash")


def run_grid(bars: DataFrame | None, events: DataFrame | None, runs: list, keys: Sequence[str] = ("symbol",),
             bar_seconds: int = P.SMALLEST_BAR_SECONDS, seg_rows: int = ordered.SEG_ROWS,
             indicators: dict | None = None) -> BacktestResult:
    """Many parameter sets in one job, keyed by (run_id, *keys).

    Indicators are computed once per distinct Bollinger window (usually one;
    ``indicators`` may supply them). The runs are a literal list: each
    indicator row is expanded once per run (a generate over a literal array,
    no join), the run parameters become columns, and every later window,
    carry and aggregate is keyed by ``run_id`` as well.
    """
    keys = list(keys)
    rkeys = ["run_id", *keys]
    parts = []
    for bb in sorted({p.bb_window for p in runs}):
        if indicators and bb in indicators:
            ind = indicators[bb]
        else:
            ind = I.compute_indicators(bars, keys, bb_window=bb, trend_method=None, bar_seconds=bar_seconds,
                                       seg_rows=seg_rows)
        spec = F.array(*[F.struct(
            F.lit(p.run_id).alias("run_id"), F.lit(float(p.hv_min)).alias("p_hv_min"),
            F.lit(float(p.hv_max)).alias("p_hv_max"), F.lit(float(p.adx_exit_threshold)).alias("p_adx_exit"),
            F.lit(float(p.vwap_exit_k)).alias("p_vwap_k"), F.lit(bool(p.use_bias)).alias("p_use_bias"),
            F.lit(float(p.bias_strength)).alias("p_bias"), F.lit(p.trend_method).alias("p_trend"),
            F.lit(float(p.wing_ext_pct)).alias("p_wing_ext")) for p in runs if p.bb_window == bb])
        parts.append(ind.select("*", F.explode(spec).alias("_p")).select("*", "_p.*").drop("_p"))
    x = parts[0]
    for q in parts[1:]:
        x = x.unionByName(q)
    x = I.trend_flags(x, F.col("p_trend"))
    sig = signals.with_blackout_runs(x, events, runs)
    sig = signals.with_eligibility(sig, F.col("p_hv_min"), F.col("p_hv_max"))
    res = positions.resolve(sig, rkeys, "p_adx_exit", "p_vwap_k", "p_use_bias",
                            "p_bias", "p_wing_ext", seg_rows=seg_rows)
    return ledger_outputs(res, rkeys, seg_rows)
