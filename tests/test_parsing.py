"""Timestamp and number parsing, catalog rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from barspark.operators import catalog, quality
from barspark.sources.fixtures import text_id


def test_timestamps(spark):
    want = {
        "2024-01-02 09:30:00": (2024, 1, 2, 9, 30), "2024-01-02 09:30:00.123": (2024, 1, 2, 9, 30, 0, 123000),
        "2024-01-02T09:30:00.5": (2024, 1, 2, 9, 30, 0, 500000), "2024-01-02T09:30:00Z": (2024, 1, 2, 9, 30),
        "2024-01-02T09:30:00+00:00": (2024, 1, 2, 9, 30), "2024-01-02 09:30:00-05:00": (2024, 1, 2, 14, 30),
        "2024-01-02 09:30:00+0530": (2024, 1, 2, 4, 0), "1/2/2024": (2024, 1, 2), "01/02/2024 09:30": (2024, 1, 2, 9, 30),
        " 2024/3/4 1:02:03 ": (2024, 3, 4, 1, 2, 3), "2024-01-02": (2024, 1, 2), "2024-01-02 09:30": (2024, 1, 2, 9, 30),
        "bad": None, "": None, "12345": None, "2024-13-01": None, "2024-01-02 25:00:00": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in want], "s string").select("s", quality.parse_ts("s").alias("t"))
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = {r.s: r.t for r in df.collect()}
        assert got == {k: v and dt.datetime(*v) for k, v in want.items()}, zone
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([("NaN",), ("1.5",), ("x",), (None,), ("inf",)], "s string")
    assert [r[0] for r in df.select(quality.number(F.col("s"))).collect()] == [None, 1.5, None, None, float("inf")]


def test_catalog_rules(spark):
    symbols = spark.createDataFrame([("AAPL.X",), ("AAPL.Y",)], "symbol string").select(text_id(F.col("symbol")).alias("id"))
    assert symbols.distinct().count() == 2
    cols = "symbol_id bigint, symbol string, asset_type string, vendor string, description string, created_at int, updated_at int"
    old = spark.createDataFrame([(1, "a", "x", "v", "d", 1, 1), (2, "b", "x", "v", "d", 1, 1)], cols)
    new = spark.createDataFrame([(9, "a", None, "w", None, 5, 5), (3, "c", "y", None, None, 5, 5)], cols)
    got = {r.symbol: tuple(r) for r in catalog.upsert_symbols(old, new).collect()}
    assert got == {"a": (1, "a", None, "w", None, 1, 5), "b": (2, "b", "x", "v", "d", 1, 1), "c": (3, "c", "y", None, None, 5, 5)}
    ds = spark.createDataFrame([(1, "p")], "dataset_id bigint, file_path string")
    batch = spark.createDataFrame([(5, "q"), (4, "q"), (6, "p")], "dataset_id bigint, file_path string")
    assert sorted(map(tuple, catalog.register_datasets(ds, batch).collect())) == [(1, "p"), (4, "q")]
    assert spark.range(1).select(catalog.mb(F.lit(3200))).first()[0] == 0.0
