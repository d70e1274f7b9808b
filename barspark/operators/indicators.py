"""Technical indicators over bars, per key, as one segmented window plan.

Plan shape: row index (one exchange of the bars) -> halo segments (one
exchange, bounded partitions) -> all lookback windows share the
(key, segment, idx) ordering, so Catalyst sorts once and chains the Window
operators -> home rows -> back/forward fills with a per-segment carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..plans import ordered
from ..plans.scan import with_ewm
from ..session import cut_lineage

ALPHA = 1.0 / P.RSI_PERIOD
FILLED = ["rsi", "adx", "hv"]
INDICATOR_COLUMNS = ["bb_mid", "bb_upper", "bb_lower", "rsi", "atr", "plus_di", "minus_di", "adx",
                     "vwap_sma20", "bb_width", "bb_tightening", "hv"]
REQUIRED_INDICATORS = ["bb_mid", "bb_upper", "bb_lower", "rsi", "adx", "plus_di", "minus_di",
                       "hv", "vwap_sma20", "bb_width", "bb_tightening"]


def indicator_lookback(bb_window: int) -> int:
    """Rows of history the windowed indicators read for one output row (the
    exponential averages carry their whole history, see ``plans.scan``)."""
    return max(bb_window + P.BB_TIGHTENING_WINDOW, P.HV_WINDOW + 1, P.VWAP_SMA_WINDOW) + 2


def _nullif0(c):
    return F.when(c != 0, c)


def _rolling_gated(x, keys, n, min_count=None):
    mean, std, cnt = ordered.rolling_mean_std(x, keys, n)
    ok = cnt >= F.lit(n if min_count is None else min_count)
    return F.when(ok, mean), F.when(ok, std)


def indexed_bars(bars: DataFrame, keys: Sequence[str] = ("symbol",), bar_seconds: int = P.SMALLEST_BAR_SECONDS) -> DataFrame:
    """Bars with a per-key 0-based ``idx`` in time order.

    The bars (already the reduced table) are materialised first: the row
    index reads them twice, and a lineage cut here keeps an executor loss from
    re-aggregating the ticks."""
    if "idx" in bars.columns:
        return bars
    return ordered.with_row_index(cut_lineage(bars), keys, ["ts"], "ts", bar_seconds)


def compute_raw(bars: DataFrame, keys: Sequence[str] = ("symbol",), bb_window: int = P.BB_BASE_WINDOW,
                bar_seconds: int = P.SMALLEST_BAR_SECONDS, seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    """All indicators before fills; output keeps ``_seg`` (home rows only).

    Two exchanges of bar rows: the row index and the halo. The rows with their window
    columns are written once, as dealt by (keys, segment): the averages read them several
    times and move none."""
    keys = list(keys)
    b = indexed_bars(bars, keys, bar_seconds)
    h = ordered.halo(b, back=indicator_lookback(bb_window), seg_rows=seg_rows)
    h = averages(cut_lineage(ordered.home(windows(h, keys, bb_window))), keys)
    return h.select(*[c for c in bars.columns if c != "idx"], "idx", ordered.SEG, *RAW_COLUMNS)


def windows(h: DataFrame, keys: Sequence[str], bb_window: int = P.BB_BASE_WINDOW) -> DataFrame:
    """Columns of bounded look-back, on rows that hold their halo."""
    keys = list(keys)
    W = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in [*keys, ordered.SEG])} ORDER BY `idx`"
    h = h.selectExpr("*", f"lag(close) {W}) AS _pc", f"lag(high) {W}) AS _ph", f"lag(low) {W}) AS _pl",
                     f"lag(vwap) {W}) AS _pvw")
    up, dn = "(high - _ph)", "(-(low - _pl))"
    h = h.selectExpr(
        "*",
        "CASE WHEN (close - _pc) IS NOT NULL THEN greatest(close - _pc, 0.0D) END AS _gain",
        "CASE WHEN (close - _pc) IS NOT NULL THEN -least(close - _pc, 0.0D) END AS _loss",
        f"CASE WHEN {up} IS NULL THEN NULL WHEN {up} > {dn} AND {up} > 0 THEN {up} ELSE 0.0D END AS _pdm",
        f"CASE WHEN {dn} IS NULL THEN NULL WHEN {dn} > {up} AND {dn} > 0 THEN {dn} ELSE 0.0D END AS _mdm",
        "greatest(high - low, abs(high - _pc), abs(low - _pc)) AS tr",
        "ln(close) - ln(_pc) AS _lr",
        "vwap - _pvw AS vwap_delta")

    mid, std = _rolling_gated("vwap", keys, bb_window)
    sma, _ = _rolling_gated("vwap", keys, P.VWAP_SMA_WINDOW)
    _, lr_std = _rolling_gated("_lr", keys, P.HV_WINDOW)
    h = h.select("*", mid.alias("bb_mid"), std.alias("_bstd"), sma.alias("vwap_sma20"),
                 (lr_std * F.lit(P.ANNUALIZATION_FACTOR ** 0.5) * F.lit(100.0)).alias("hv"))
    k = f"{P.BB_STD_MULTIPLIER!r}D"
    h = h.selectExpr("*", f"bb_mid + {k} * _bstd AS bb_upper", f"bb_mid - {k} * _bstd AS bb_lower")
    h = h.selectExpr("*", "bb_upper - bb_lower AS bb_width")
    tw = f"{W} ROWS BETWEEN {P.BB_TIGHTENING_WINDOW - 1} PRECEDING AND CURRENT ROW)"
    return h.selectExpr("*", f"coalesce(bb_width < lag(bb_width) {W}) AND bb_width < CASE WHEN count(bb_width) {tw} "
                             f">= {P.BB_TIGHTENING_MIN_PERIODS} THEN percentile(bb_width, 0.5) {tw} END, false) "
                             f"AS bb_tightening")


#: Averages (out: source column) by round; the second round needs the first.
AVERAGES = ({"_ag": "_gain", "_al": "_loss", "atr": "tr", "_pde": "_pdm", "_mde": "_mdm"}, {"adx": "_dx"})
RAW_COLUMNS = ["bb_mid", "bb_upper", "bb_lower", "rsi", "atr", "plus_di", "minus_di", "adx", "vwap_sma20", "bb_width",
               "bb_tightening", "hv", "vwap_delta", "tr"]


def averages(h: DataFrame, keys: Sequence[str], before: DataFrame | None = None) -> DataFrame:
    """RSI, ATR, DI and ADX of rows dealt by (keys, segment), from the start or from stored states.

    The second round reads the first one twice, so that is written once."""
    h = cut_lineage(with_ewm(h, keys, AVERAGES[0], ALPHA, before=before))
    rs = F.try_divide(F.col("_ag"), _nullif0(F.col("_al")))
    h = h.select("*",
                 (F.lit(100.0) - F.try_divide(F.lit(100.0), F.lit(1.0) + rs)).alias("rsi"),
                 (F.lit(100.0) * F.try_divide(F.col("_pde"), F.col("atr"))).alias("plus_di"),
                 (F.lit(100.0) * F.try_divide(F.col("_mde"), F.col("atr"))).alias("minus_di"))
    pdi, mdi = F.col("plus_di"), F.col("minus_di")
    h = h.withColumn("_dx", F.try_divide(F.abs(pdi - mdi), _nullif0(pdi + mdi)) * F.lit(100.0))
    return with_ewm(h, keys, AVERAGES[1], ALPHA, before=before)


def trend_flags(df: DataFrame, method=P.DEFAULT_TREND_METHOD) -> DataFrame:
    """trend_up / trend_down by method; any other method -> both false.
    ``method`` may be a per-run column."""
    if isinstance(method, F.Column):
        vd, sma = F.col("vwap_delta"), F.col("vwap_sma20")
        pdi, mdi, strong = F.col("plus_di"), F.col("minus_di"), F.col("adx") > P.TREND_ADX_LEVEL
        up = (F.when(method == "VWAP Slope", vd > 0).when(method == "VWAP vs SMA20", F.col("vwap") > sma)
               .when(method == "ADX + DI", (pdi > mdi) & strong).otherwise(F.lit(False)))
        down = (F.when(method == "VWAP Slope", vd < 0).when(method == "VWAP vs SMA20", F.col("vwap") < sma)
                 .when(method == "ADX + DI", (mdi > pdi) & strong).otherwise(F.lit(False)))
    elif method == "VWAP Slope":
        up, down = F.col("vwap_delta") > 0, F.col("vwap_delta") < 0
    elif method == "VWAP vs SMA20":
        up, down = F.col("vwap") > F.col("vwap_sma20"), F.col("vwap") < F.col("vwap_sma20")
    elif method == "ADX + DI":
        strong = F.col("adx") > P.TREND_ADX_LEVEL
        up = (F.col("plus_di") > F.col("minus_di")) & strong
        down = (F.col("minus_di") > F.col("plus_di")) & strong
    else:
        up = down = F.lit(False)
    return df.withColumn("trend_up", F.coalesce(up, F.lit(False))) \
             .withColumn("trend_down", F.coalesce(down, F.lit(False)))


def compute_indicators(bars: DataFrame, keys: Sequence[str] = ("symbol",), bb_window: int = P.BB_BASE_WINDOW,
                       trend_method: str | None = P.DEFAULT_TREND_METHOD, bar_seconds: int = P.SMALLEST_BAR_SECONDS,
                       fill: str = "both", seg_rows: int = ordered.SEG_ROWS, keep_seg: bool = False,
                       materialize: bool = True) -> DataFrame:
    """Indicators + trend flags. ``fill='both'`` reproduces the back-then-forward
    fill of rsi/adx/hv (which reads future values into the warm-up);
    ``fill='none'`` leaves them NULL there.

    The fill reads the raw frame twice (local pass + segment carry). With
    ``materialize`` (default) the raw frame is cached only while the finished
    indicator frame is checkpointed, then released; otherwise the raw frame
    itself is checkpointed and the result stays lazy.
    """
    keys = list(keys)
    raw = compute_raw(bars, keys, bb_window, bar_seconds, seg_rows)
    cached = None
    if fill == "both":
        if materialize:
            cached = raw.persist(StorageLevel.MEMORY_AND_DISK)
            out = ordered.fill_both(cached, keys, FILLED)
        else:
            out = ordered.fill_both(cut_lineage(raw), keys, FILLED)
    else:
        out = raw
    if trend_method is not None:
        out = trend_flags(out, trend_method)
    out = out if keep_seg else out.drop(ordered.SEG)
    if materialize:
        out = cut_lineage(out)
        if cached is not None:
            cached.unpersist()
    return out


def validate_indicators(ind: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Per key: every required indicator column exists and is not all-NULL."""
    missing = [c for c in REQUIRED_INDICATORS if c not in ind.columns]
    if missing:
        return ind.select(*keys).distinct().withColumn("indicators_valid", F.lit(False))
    cnts = [F.count(F.when(F.col(c).cast("double").isNotNull() if c != "bb_tightening"
                           else F.col(c).isNotNull(), 1)).alias(f"n_{c}") for c in REQUIRED_INDICATORS]
    g = ind.groupBy(*keys).agg(*cnts)
    ok = None
    for c in REQUIRED_INDICATORS:
        term = F.col(f"n_{c}") > 0
        ok = term if ok is None else ok & term
    return g.select(*keys, ok.alias("indicators_valid"))


def bollinger(bars: DataFrame, keys: Sequence[str] = ("symbol",), column: str = "vwap",
              window: int = P.BB_BASE_WINDOW, bar_seconds: int = P.SMALLEST_BAR_SECONDS,
              seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    """Bands on any column (the fallback form uses ``close``)."""
    keys = list(keys)
    h = ordered.halo(indexed_bars(bars, keys, bar_seconds), back=window, seg_rows=seg_rows)
    mid, std = _rolling_gated(column, keys, window)
    h = ordered.home(h.select("*", mid.alias("bb_mid"), std.alias("_s")))
    k = F.lit(P.BB_STD_MULTIPLIER)
    return h.select(*keys, "ts", "idx", "bb_mid", (F.col("bb_mid") + k * F.col("_s")).alias("bb_upper"),
                    (F.col("bb_mid") - k * F.col("_s")).alias("bb_lower"))


def ewm_series(bars: DataFrame, keys: Sequence[str] = ("symbol",), column: str = "close", alpha: float = ALPHA,
               out: str = "ewm", bar_seconds: int = P.SMALLEST_BAR_SECONDS) -> DataFrame:
    """The shared exponentially weighted mean as an operator of its own."""
    keys = list(keys)
    h = with_ewm(indexed_bars(bars, keys, bar_seconds), keys, {out: column}, alpha)
    return h.select(*keys, "ts", "idx", out)
