"""Queries over the stored bars table (symbol, timeframe, ts, OHLCV...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resample import resample_ohlcv

#: Rows of a catalog table that may be broadcast.
CATALOG_ROWS = 100_000


def bars_range(store: DataFrame, timeframe: str, symbol: str | None = None, start: str | None = None,
               end: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Bars of symbol@timeframe in [start, end]. ``end`` is a date compared as
    midnight, so intraday bars of the last day are excluded. Filters reach the
    Parquet scan (partition columns symbol/timeframe, min/max stats on ts)."""
    d = store.filter(F.col("timeframe") == timeframe)
    if symbol is not None:
        d = d.filter(F.col("symbol") == symbol)
    if start:
        d = d.filter(F.col("ts") >= F.to_timestamp(F.lit(start)).cast("timestamp_ntz"))
    if end:
        d = d.filter(F.col("ts") <= F.to_timestamp(F.lit(end)).cast("timestamp_ntz"))
    cols = ["symbol", "ts", *[c for c in (columns or []) if c not in ("symbol", "ts")]] if columns else d.columns
    return d.select(*cols).orderBy("symbol", "ts")


def top_rows(bars: DataFrame, n: int, keys: Sequence[str] = ("symbol",), latest: bool = False) -> DataFrame:
    """First (or last) ``n`` rows per key, returned in ascending time.

    ``row_number() <= n`` is planned with a per-partition group limit before
    the exchange, so at most n rows per key and map task are shuffled."""
    o = F.col("ts").desc() if latest else F.col("ts").asc()
    w = Window.partitionBy(*keys).orderBy(o)
    return bars.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def bars_latest(store: DataFrame, datasets: DataFrame, symbols: DataFrame, timeframe: str, n: int) -> DataFrame:
    """Last ``n`` bars of the dataset with the latest end date, per symbol.

    The catalog side has one row a symbol; it is broadcast when it has at most
    ``CATALOG_ROWS`` rows, so the bars stay where they are."""
    day = lambda c: F.to_date(c).cast("timestamp_ntz")
    ds = (datasets.filter(F.col("timeframe") == timeframe)
                  .join(symbols.select("symbol_id", "symbol"), "symbol_id")
                  .groupBy("symbol").agg(F.max_by("start_date", "end_date").alias("_s"), F.max("end_date").alias("_e"))
                  .select("symbol", day("_s").alias("_s"), (day("_e") + F.expr("INTERVAL 1 DAY")).alias("_e")))
    few = ds.limit(CATALOG_ROWS + 1).count() <= CATALOG_ROWS
    b = store.filter(F.col("timeframe") == timeframe).join(F.broadcast(ds) if few else ds, "symbol")
    b = b.filter((F.col("ts") >= F.col("_s")) & (F.col("ts") < F.col("_e"))).drop("_s", "_e")
    return top_rows(b, n, ["symbol"], latest=True)


def bars_resampled(store: DataFrame, timeframe: str, target: str, start: str | None = None,
                   end: str | None = None) -> DataFrame:
    r = bars_range(store, timeframe, None, start, end)
    return resample_ohlcv(r, target, keys=["symbol"], ts="ts", seq=None)
