"""Tick/bar -> bar resampling (tumbling buckets anchored at midnight).

A single ``groupBy(key, bucket)`` whose aggregates are all partial-aggregable
(first/last via ``min_by``/``max_by`` on one decimal made of time and seq), so the
tick-scale step is a hash aggregate that combines map-side and shuffles one row
per (key, bucket, map task); no tick is ever sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import CATALOG_TIMEFRAME_SECONDS, timeframe_seconds


def bucket_start(ts: str, seconds: int) -> F.Column:
    """Left-closed, left-labelled bucket of ``seconds`` anchored at the epoch
    (= midnight for every width that divides a day)."""
    return F.window(ts, f"{int(seconds)} seconds").start


def order_key(ts: str, seq: str | None = None) -> F.Column:
    """A number that orders like (ts, seq): microseconds, then the full range of a bigint."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    if seq is None:
        return micros
    rank = F.col(seq).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    return (micros.cast("decimal(18,0)") * F.lit(Decimal(10 ** 20)) + rank).cast("decimal(38,0)")


def resample_seconds(df: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",),
                     ts: str = "ts", seq: str | None = "seq",
                     columns: Sequence[str] = ("open", "high", "low", "close", "vwap", "volume")) -> DataFrame:
    keys = list(keys)
    present = [c for c in columns if c in df.columns]
    df = df.withColumn("_order", order_key(ts, seq if seq and seq in df.columns else None))
    order = F.col("_order")
    aggs = []
    for c in present:
        x = F.col(c)
        keyed = F.when(x.isNotNull(), order)       # first/last skip missing values
        if c == "open":
            aggs.append(F.min_by(x, keyed).alias(c))
        elif c == "high":
            aggs.append(F.max(x).alias(c))
        elif c == "low":
            aggs.append(F.min(x).alias(c))
        elif c == "close":
            aggs.append(F.max_by(x, keyed).alias(c))
        elif c == "vwap":
            aggs.append(F.avg(x).alias(c))          # unweighted mean of the bucket
        elif c == "volume":
            aggs.append(F.coalesce(F.sum(x), F.lit(0.0)).alias(c))   # sum of nothing is 0
    g = (df.withColumn("_bucket", bucket_start(ts, seconds))
           .groupBy(*keys, "_bucket").agg(*aggs)
           .withColumnRenamed("_bucket", ts))
    # Incomplete bars (any missing aggregate) are dropped.
    return g.dropna(how="any", subset=present).select(*keys, ts, *present)


def resample_bars(df: DataFrame, timeframe: str = "Daily", keys: Sequence[str] = ("symbol",),
                  ts: str = "ts", seq: str | None = "seq") -> DataFrame:
    """Strategy resampler: Daily/Hourly/30/15/5/1-minute (unknown -> Daily)."""
    return resample_seconds(df, timeframe_seconds(timeframe), keys, ts, seq)


def resample_ohlcv(df: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",),
                   ts: str = "ts", seq: str | None = "seq") -> DataFrame:
    """Catalog resampler: 1min/5min/15min/1h/1d, OHLCV only (vwap dropped)."""
    if timeframe not in CATALOG_TIMEFRAME_SECONDS:
        raise ValueError(f"Unsupported timeframe: {timeframe}")
    return resample_seconds(df, CATALOG_TIMEFRAME_SECONDS[timeframe], keys, ts, seq,
                            columns=("open", "high", "low", "close", "volume"))
