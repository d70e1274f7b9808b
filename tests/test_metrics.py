"""Literal expectations of the original unit tests, re-expressed on DataFrames."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from barspark import params as P
from barspark.operators import metrics, positions, signals
from barspark.plans import ordered


def _trades(spark, rows):
    df = spark.createDataFrame(rows, "pnl double, outcome string, short_put double, long_put double, "
                                     "short_call double, long_call double, net_credit double")
    # row order of the literal list; ids are increasing but not consecutive
    df = df.withColumn("symbol", F.lit("S")).withColumn("idx", F.monotonically_increasing_id())
    df = df.withColumn("_win", (F.col("outcome") == "win").cast("int")) \
           .withColumn("_loss", (F.col("outcome") == "loss").cast("int")).withColumn("_one", F.lit(1))
    df = ordered.running(df.withColumn(ordered.SEG, F.lit(0)), ["symbol"], ["idx"],
                         {"trade_no": "_one", "wins_so_far": "_win", "losses_so_far": "_loss"})
    return df


def _equity(spark, cash):
    rows = [("S", i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(c)) for i, c in enumerate(cash)]
    e = spark.createDataFrame(rows, "symbol string, idx long, ts timestamp_ntz, cash double")
    return ordered.segment(e)


def test_summary_on_five_trades(spark):
    rows = [(100.0, "win", 95.0, 90.0, 105.0, 110.0, 1.5), (-50.0, "loss", 95.0, 90.0, 105.0, 110.0, 1.5),
            (75.0, "win", 95.0, 90.0, 105.0, 110.0, 1.5), (-30.0, "loss", 95.0, 90.0, 105.0, 110.0, 1.5),
            (120.0, "win", 95.0, 90.0, 105.0, 110.0, 1.5)]
    from barspark.operators.ledger import drawdown_series
    dd = drawdown_series(_equity(spark, [100, 50, 125, 95, 215]), ["symbol"])
    s = metrics.summary(_trades(spark, rows), dd).collect()[0]
    assert (s.trades, s.wins, s.losses) == (5, 3, 2)
    assert s.win_rate == pytest.approx(60.0)
    assert s.total_pnl == pytest.approx(215.0)
    assert s.avg_pnl == pytest.approx(43.0)
    assert s.max_drawdown == pytest.approx(50.0)
    assert s.max_drawdown_pct == pytest.approx(50.0)


@pytest.mark.parametrize("mask,expected", [([True] * 10, 10), ([True, False] * 2, 1),
                                           ([False, False, True, True, True, False], 3), ([], 0)])
def test_longest_streak(spark, mask, expected):
    rows = [(1.0, "win" if m else "breach", 95.0, 90.0, 105.0, 110.0, 1.5) for m in mask]
    if not rows:
        assert expected == 0
        return
    st = metrics.streaks(_trades(spark, rows)).collect()
    got = st[0].win_streak if st and st[0].win_streak is not None else 0
    assert got == expected


def test_condor_pnl_signs(spark):
    df = spark.createDataFrame([(100.0,), (110.0,)], "price double")
    pnl, outcome = positions.condor_pnl(F.col("price"), F.lit(95.0), F.lit(90.0), F.lit(105.0), F.lit(110.0),
                                        F.lit(0.5))
    r = df.select(pnl.alias("pnl"), outcome.alias("o")).collect()
    assert r[0].o == "win" and r[0].pnl > 0
    assert r[1].o == "loss" and r[1].pnl < 0
    # a loss always takes the full width of the breached side
    assert r[1].pnl == pytest.approx(-(5.0 - 0.5) * 100 - 4 * P.PER_LEG_FEE)


def test_blackout_window_size(spark):
    bars = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=i),) for i in range(30)],
                                 "ts timestamp_ntz")
    ev = spark.createDataFrame([(dt.date(2024, 1, 15),)], "event_date date")
    m = signals.with_blackout(bars, ev, 3, 1)
    assert m.filter("blackout").count() == 5
    assert signals.with_blackout(bars, None).filter("blackout").count() == 0


def test_window_sizes():
    assert P.bb_window("Daily") == 20
    assert P.bb_window("Hourly") == 130
    assert P.bb_window("1-minute") == 7800
    assert P.bb_window("unknown") == 20


def test_histogram_degenerate_and_edges(spark):
    rows = [(147.4, "win", 95.0, 90.0, 105.0, 110.0, 1.5)] * 3
    h = metrics.pnl_histogram(_trades(spark, rows), bins=20).orderBy("bin").collect()
    assert len(h) == 20 and sum(r["count"] for r in h) == 3
    assert h[0].bin_center == pytest.approx(147.4 - 0.5 + 0.025)
    rows = [(float(x), "win", 95.0, 90.0, 105.0, 110.0, 1.5) for x in (0, 1, 2, 3, 10)]
    h = metrics.pnl_histogram(_trades(spark, rows), bins=5).orderBy("bin").collect()
    assert [r["count"] for r in h] == [2, 2, 0, 0, 1]          # max value lands in the last bin
