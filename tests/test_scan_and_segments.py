"""EWM scan vs pandas, and segment (halo / two-level) invariance."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators import indicators as I
from barspark.operators.resample import resample_bars
from barspark.plans import ordered
from barspark.plans.scan import with_ewm
from barspark.sources.fixtures import ticks_orders


def test_ewm_matches_pandas_with_gaps(spark):
    rng = np.random.default_rng(7)
    n = 3000
    x = rng.normal(size=n).cumsum()
    x[rng.random(n) < 0.03] = np.nan
    x[:5] = np.nan                    # leading gap
    x[1000:1040] = np.nan             # a 40-row gap
    pdf = pd.DataFrame({"k": "a", "idx": np.arange(n), "x": x})
    x[1100:2650] = np.nan             # a gap longer than two blocks
    pdf["x"] = x
    df = spark.createDataFrame(pdf.astype({"x": "float64"})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    ref = pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean()
    for block_rows, fan in ((512, 128), (32, 4), (7, 3)):
        out = with_ewm(df, ["k"], {"y": "x"}, 1 / 14, block_rows=block_rows, fan=fan).orderBy("idx").toPandas()
        assert out["y"].isna().tolist() == ref.isna().tolist()
        assert np.nanmax(np.abs(out["y"].to_numpy(dtype=float) - ref.to_numpy())) < 1e-10


def test_rsi_keeps_its_history_over_a_flat_stretch(spark):
    rng = np.random.default_rng(5)
    close = np.concatenate([100 + rng.normal(size=600).cumsum(), np.zeros(2100), rng.normal(size=50).cumsum()])
    close[600:2700] = close[599]
    close[2700:] += close[599]
    n = len(close)
    pdf = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2000-01-01", periods=n), "close": close})
    for c in ("open", "vwap"):
        pdf[c] = close
    pdf["high"], pdf["low"], pdf["volume"] = close + 0.5, close - 0.5, 1.0
    bars = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = I.compute_indicators(bars, fill="none").orderBy("ts").toPandas()["rsi"].to_numpy(dtype=float)
    diff = pd.Series(close).diff()
    up = diff.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    down = (-diff.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    ref = (100 - 100 / (1 + up / down)).to_numpy()
    assert np.nanmax(np.abs(got - ref)) < 1e-6
    assert abs(got[2690] - got[610]) < 1e-6


def test_indicators_invariant_to_segment_size(spark, sf):
    bars = resample_bars(ticks_orders(spark, sf))
    big = I.compute_indicators(bars, seg_rows=1 << 16).orderBy("symbol", "ts").toPandas()
    # 300-row segments: every symbol spans several segments, halos and carries are exercised
    small = I.compute_indicators(bars, seg_rows=300).orderBy("symbol", "ts").toPandas()
    assert len(big) == len(small)
    for c in I.INDICATOR_COLUMNS:
        a, b = big[c].astype(float).to_numpy(), small[c].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all(), c
        assert np.nanmax(np.abs(a - b)) < 1e-9, c


def test_running_and_fill_two_level(spark):
    rng = np.random.default_rng(3)
    n = 1000
    v = rng.normal(size=n)
    v[rng.random(n) < 0.2] = np.nan
    v[:30] = np.nan
    v[-25:] = np.nan
    pdf = pd.DataFrame({"k": "a", "idx": np.arange(n), "v": v, "one": 1.0})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    df = ordered.segment(df, "idx", 64)
    r = ordered.running(df, ["k"], ["idx"], {"c": "one"})
    r = ordered.running(r, ["k"], ["idx"], {"m": "v"}, op="max")
    f = ordered.fill_both(r, ["k"], ["v"]).orderBy("idx").toPandas()
    assert f["c"].tolist() == list(np.arange(1, n + 1, dtype=float))
    assert np.allclose(f["m"].to_numpy(dtype=float), pd.Series(v).cummax().ffill().to_numpy(), equal_nan=True)
    assert np.allclose(f["v"].to_numpy(dtype=float), pd.Series(v).bfill().ffill().to_numpy())


def test_row_index_across_buckets(spark):
    import datetime as dt
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i)) for i in range(500)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz")
    out = ordered.with_row_index(df, ["symbol"], ["ts"], "ts", bar_seconds=60, rows_per_bucket=50)
    got = [r.idx for r in out.orderBy("ts").collect()]
    assert got == list(range(500))


def test_long_window_prefix_sums_match_frames(spark):
    rng = np.random.default_rng(11)
    n = 3000
    v = 100 + rng.normal(size=n).cumsum()
    v[rng.random(n) < 0.02] = np.nan
    v[1500:2600] = 104.123             # fully flat windows
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "idx": np.arange(n), "v": v})) \
        .withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    df = ordered.segment(df, "idx", 1 << 16)
    m1, s1, c1 = ordered.rolling_mean_std("v", ["k"], 450)                       # two runs
    m2, s2, c2 = ordered.rolling_mean_std("v", ["k"], 450, framed_to=10_000)  # frames
    out = df.select("idx", m1.alias("m1"), s1.alias("s1"), c1.alias("c1"),
                    m2.alias("m2"), s2.alias("s2"), c2.alias("c2")).orderBy("idx").toPandas()
    assert (out["c1"] == out["c2"]).all()
    assert np.nanmax(np.abs(out["m1"] - out["m2"])) < 1e-8
    assert np.nanmax(np.abs(out["s1"] - out["s2"])) < 1e-11
    assert (out["s1"][1500 + 449:2600] == 0).all() and (out["s2"][1500 + 449:2600] == 0).all()
    ref = pd.Series(v).rolling(450, min_periods=1).std(ddof=0)
    assert np.nanmax(np.abs(out["s2"].to_numpy() - ref.to_numpy())) < 1e-8
