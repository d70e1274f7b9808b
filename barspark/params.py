"""Run parameters and the fixed constants of the strategy.

Every operator takes plain Python parameters (resolved on the driver into
literal columns), so a run is one lazy plan. Many runs at once are handled by
``RunParams`` rows exploded into a ``run_id`` key (see ``operators.runs``).
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original application's configuration for
# results to match; they are stated here plainly and in their natural order.
# ---------------------------------------------------------------------------
PER_LEG_FEE = 0.65
CONTRACT_MULTIPLIER = 100
DEFAULT_WING_WIDTH = 5.0
DEFAULT_CREDIT_MULTIPLIER = 0.30

#: Period of the exponential averages of RSI, ATR, DI and ADX.
RSI_PERIOD = 14
BB_BASE_WINDOW = 20
HV_WINDOW = 21
VWAP_SMA_WINDOW = 20
BB_STD_MULTIPLIER = 2.0
BB_TIGHTENING_WINDOW = 20
BB_TIGHTENING_MIN_PERIODS = 5
ANNUALIZATION_FACTOR = 252

DEFAULT_HV_MIN = 15.0
DEFAULT_HV_MAX = 40.0
DEFAULT_ADX_EXIT = 30
DEFAULT_VWAP_K = 1.0
DEFAULT_TREND_METHOD = "VWAP Slope"
DEFAULT_BIAS_STRENGTH = 2.0
DEFAULT_WING_EXT_PCT = 20.0
DEFAULT_DAYS_BEFORE = 7
DEFAULT_DAYS_AFTER = 1

ADX_ENTRY_THRESHOLD = 20
RSI_LOWER_BOUND = 40
RSI_UPPER_BOUND = 60

MIN_ROWS = 100
MAX_TABLE_ROWS = 1000
EXPIRY_MAX_BARS = 5
TREND_ADX_LEVEL = 20

# Strategy timeframes -> bucket width in seconds ("Daily" is the fallback).
TIMEFRAME_SECONDS = {
    "Daily": 86400,
    "Hourly": 3600,
    "30-minute": 1800,
    "15-minute": 900,
    "5-minute": 300,
    "1-minute": 60,
}
# Bollinger window multipliers per strategy timeframe (unknown -> 1.0).
TIMEFRAME_BB_MULTIPLIERS = {
    "Daily": 1.0,
    "Hourly": 6.5,
    "30-minute": 13.0,
    "15-minute": 26.0,
    "5-minute": 78.0,
    "1-minute": 390.0,
}
# Catalog timeframes accepted by the OHLCV resampler of stored bars.
CATALOG_TIMEFRAME_SECONDS = {
    "1min": 60,
    "5min": 300,
    "15min": 900,
    "1h": 3600,
    "1d": 86400,
}
REJECT_REASONS = ("HV outside range", "ADX too high", "RSI out of range", "Blackout window")
EXPORT_DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
VERSION = "2.0.0"
# ---------------------------------------------------------------------------


#: Bars are at least this far apart; the safe default where no timeframe is given.
SMALLEST_BAR_SECONDS = min(TIMEFRAME_SECONDS.values())


def timeframe_seconds(timeframe: str) -> int:
    """Bucket width of a strategy timeframe; unknown names fall back to daily."""
    return TIMEFRAME_SECONDS.get(timeframe, TIMEFRAME_SECONDS["Daily"])


def bb_window(timeframe: str, base: int = BB_BASE_WINDOW) -> int:
    """Bollinger lookback in bars that keeps roughly 20 trading days."""
    return int(base * TIMEFRAME_BB_MULTIPLIERS.get(timeframe, 1.0))


@dataclass(frozen=True)
class RunParams:
    """The eleven run parameters of one backtest (defaults as in the app)."""

    hv_min: float = DEFAULT_HV_MIN
    hv_max: float = DEFAULT_HV_MAX
    adx_exit_threshold: float = DEFAULT_ADX_EXIT
    vwap_exit_k: float = DEFAULT_VWAP_K
    use_bias: bool = False
    bias_strength: float = DEFAULT_BIAS_STRENGTH
    trend_method: str = DEFAULT_TREND_METHOD
    wing_ext_pct: float = DEFAULT_WING_EXT_PCT
    days_before: int = DEFAULT_DAYS_BEFORE
    days_after: int = DEFAULT_DAYS_AFTER
    bb_window: int = BB_BASE_WINDOW
    run_id: str = field(default="run-0", compare=False)

    def as_dict(self) -> dict:
        return asdict(self)
