"""Equity curve and drawdown: running sums/maxima in two levels (per segment
locally, plus a carry from the per-segment summary)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ordered


def equity_curve(res: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Every bar: cash = P&L of all trades closed up to and including it.

    ``res`` is the resolved bar frame (home rows, ``_seg``, ``exit_pnl``).
    Output keeps ``_seg`` so the drawdown reuses the partitioning.
    """
    keys = list(keys)
    e = res.select(*keys, ordered.SEG, "idx", "ts", "exit_pnl")
    return ordered.running(e, keys, ["idx"], {"cash": "exit_pnl"}).drop("exit_pnl")


def drawdown_series(equity: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Running peak of cash and drawdown = peak - cash per bar."""
    keys = list(keys)
    d = ordered.running(equity, keys, ["idx"], {"peak": "cash"}, op="max")
    return d.withColumn("drawdown", F.col("peak") - F.col("cash"))


def max_drawdown(dd: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Largest drawdown and its percent of the peak at the first bar reaching it
    (0 when the drawdown or that peak is 0). Two hash aggregates: the largest
    drawdown, then the first of the few bars that reach it."""
    keys = list(keys)
    top = dd.groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"))
    at = dd.join(top, keys).where(F.col("drawdown") == F.col("max_drawdown"))
    peaks = at.groupBy(*keys).agg(F.min_by("peak", "idx").alias("_peak_at"))
    g = top.join(peaks, keys, "left")
    pct = F.when((F.col("max_drawdown") > 0) & (F.col("_peak_at") != 0),
                 F.lit(100.0) * F.col("max_drawdown") / F.col("_peak_at")).otherwise(F.lit(0.0))
    return g.select(*keys, F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), pct.alias("max_drawdown_pct"))
