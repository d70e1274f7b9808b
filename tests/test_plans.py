"""Physical plans that matter at scale."""

from __future__ import annotations

import re

from barspark.operators import ledger, quality
from barspark.operators.bars import bars_latest, bars_range
from barspark.operators.resample import order_key, resample_bars, resample_ohlcv
from barspark.sources import files
from barspark.sources.fixtures import dirty_ticks, ticks_events, ticks_orders


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ticks_are_not_sorted(spark, sf):
    for df in (resample_bars(ticks_orders(spark, sf)), resample_ohlcv(ticks_events(spark, sf), "1h"), quality.clean_bars(dirty_ticks(spark, sf))):
        assert "SortAggregate" not in plan(df) and "HashAggregate" in plan(df)
    dd = spark.createDataFrame([("a", 0, 1, 5.0, 2.0), ("a", 0, 2, 7.0, 2.0), ("a", 0, 3, 9.0, 1.0)], "symbol string, _seg int, idx int, peak double, drawdown double")
    out = ledger.max_drawdown(dd)
    assert "SortAggregate" not in plan(out)
    assert out.first()[:2] == ("a", 2.0) and abs(out.first()["max_drawdown_pct"] - 40) < 1e-9


def test_order_key_orders_like_time_and_seq(spark):
    rows = [(t, s) for t in ("1969-12-31 23:59:59.999999", "2024-01-01", "2024-01-01 00:00:00.000001", "9999-12-31") for s in (-(1 << 63), -1, 0, 5, (1 << 63) - 1)]
    df = spark.createDataFrame(rows, "t string, seq bigint").selectExpr("cast(t as timestamp_ntz) as ts", "seq")
    got = [(r.ts, r.seq) for r in df.orderBy(order_key("ts", "seq")).collect()]
    assert got == sorted(got) and len(set(got)) == len(rows)


def test_stored_bars_are_pruned_and_stay(spark, sf, tmp_path):
    path = files.sink_parquet_bars(resample_bars(ticks_orders(spark, sf)).selectExpr("*", "'1d' as timeframe"), f"file://{tmp_path}/store")
    store = files.scan_parquet_bars(spark, path)
    text = plan(bars_range(store, "1d", "1-URGENT", "1995-01-01", "1996-01-01", columns=["close"]))
    assert re.search(r"PartitionFilters: \[.*timeframe", text) and re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", text)
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,close:double>", text)
    datasets = spark.createDataFrame([(1, 1, "1d", "1992-01-01", "1999-01-01"), (2, 1, "1d", "1991-01-01", "1991-02-01")],
                                     "dataset_id bigint, symbol_id bigint, timeframe string, start_date string, end_date string")
    symbols = spark.createDataFrame([(1, "1-URGENT")], "symbol_id bigint, symbol string")
    latest = bars_latest(store, datasets, symbols, "1d", 7)
    text = plan(latest)
    side = text[text.index("BroadcastHashJoin"):]
    assert "BuildRight" in side.split("\n")[0] and latest.count() == 7
