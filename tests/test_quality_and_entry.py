"""Cleaning order (dedupe before drop), validation messages, driver contract."""
import datetime as dt

import pytest

from barspark.operators import quality


def test_dedupe_precedes_dropna(spark):
    rows = [("S", "2024-01-02 00:00:00", 1, 1.0, None, 1.0, 1.0, 1.0, 1.0),    # first duplicate has a null
            ("S", "2024-01-02 00:00:00", 2, 1.0, 2.0, 0.5, 1.0, 1.0, 1.0),
            ("S", "2024-01-03 00:00:00", 3, 1.0, 0.5, 2.0, 1.0, 1.0, 1.0),     # inverted -> swapped
            ("S", "bad", 4, 1.0, 2.0, 0.5, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp string, seq long, open double, high double, "
                                     "low double, close double, vwap double, volume double")
    out = quality.clean_bars(df).collect()
    assert len(out) == 1
    assert out[0].ts == dt.datetime(2024, 1, 3) and out[0].high == 2.0 and out[0].low == 0.5


def test_validation_report_messages(spark):
    rows = [("S", "2024-01-02 00:00:00", 1.0, None, 1.0, 1.0, 1.0), ("S", "bad", 1.0, 0.5, 2.0, 1.0, 1.0),
            ("S", "2024-01-02 00:00:00", 1.0, 2.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, timestamp string, open double, high double, low double, "
                                     "close double, vwap double")
    v = quality.validation_report(df).collect()[0]
    assert not v.is_valid
    assert v.errors == ["Insufficient data: 3 rows (minimum 100 required)"]
    assert v.warnings == ["1 invalid timestamps will be dropped", "1 duplicate timestamps will be deduplicated",
                          "Column 'high' has 1 missing values", "1 bars have HIGH < LOW (will be corrected)"]
    missing = quality.validation_report(df.drop("vwap")).collect()[0]
    assert missing.errors == ["Missing required columns: {'vwap'}"]


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "total_pnl" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
