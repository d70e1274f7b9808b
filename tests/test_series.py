"""Operators over ordered series against brute force: skewed keys, ties, nulls, plans."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.operators import custom, difference, metrics, quantiles, resume
from barspark.operators import indicators as I
from barspark.operators.asof import asof_join, bucket_seconds
from barspark.operators.frames import range_frames
from barspark.operators.intervals import overlap_join
from barspark.operators.resample import resample_bars, resample_seconds
from barspark.operators.sessions import sessions
from barspark.plans import ordered
from barspark.plans.scan import with_ewm
from barspark.sources import files
from barspark.sources.fixtures import ticks_events, ticks_orders
from barspark.streaming.resample import append_arrival, resample_stream

RND = random.Random(21)
T0 = dt.datetime(2024, 1, 1)


def nodes(df):
    """(name, names of the output columns) of every node of the physical plan; reused exchanges count once."""
    def walk(p):
        out = [p.output().apply(i).name() for i in range(p.output().size())]
        yield p.nodeName(), out
        for i in range(p.children().size()):
            yield from walk(p.children().apply(i))
    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.fixture
def planned(spark):
    """Plans as they are made, without run-time changes, so that reuse shows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def times(n, hours):
    return [T0 + dt.timedelta(seconds=RND.randrange(hours * 3600)) for _ in range(n)]


@pytest.mark.parametrize(("exact", "seconds"), [(True, None), (True, 1800), (False, 900)])
def test_asof_join_with_a_hot_key(spark, exact, seconds):
    keys = ["hot"] * 300 + [f"k{k % 40}" for k in range(600)]
    left = [(k, t, i) for i, (k, t) in enumerate(zip(keys, times(900, 40)))] + [(None, T0, 900), ("hot", None, 901), ("absent", T0, 902)]
    right = list({(RND.choice(["hot", "hot", *(f"k{j}" for j in range(35))]), t.replace(minute=t.minute // 10 * 10, second=0)): None for t in times(400, 40)})
    right = [(k, t, float(i)) for i, (k, t) in enumerate(right)] + [(None, T0, -1.0), ("hot", None, -2.0)]
    left[:40] = [(k, right[i][1], n) for i, (k, _, n) in enumerate(left[:40])]        # equal times
    out = asof_join(spark.createDataFrame(left, "s string, ts timestamp_ntz, id int"), spark.createDataFrame(right, "s string, ts timestamp_ntz, v double"),
                    ["s"], ["v"], seconds=seconds, exact=exact, prefix="r_")
    got = {r.id: (r.r_ts_matched, r.r_v) for r in out.collect()}
    assert len(got) == len(left) == out.count()
    for k, t, i in left:
        fits = [(b, v) for s, b, v in right if s is not None and s == k and b is not None and t is not None and (b <= t if exact else b < t)]
        assert got[i] == (max(fits) if fits else (None, None))


def test_bucket_width_follows_the_fullest_hour(spark):
    rows = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=k)) for k in range(1000)], "k string, ts timestamp_ntz")
    assert bucket_seconds(rows, ["k"], "ts") == 86400
    assert bucket_seconds(rows, ["k"], "ts", at_most=100) == 360
    assert bucket_seconds(rows.limit(0), ["k"], "ts") == 86400


@pytest.mark.parametrize("seconds", [None, 7200, 600])
def test_sessions_of_a_skewed_user(spark, seconds):
    rows = [(1 if i % 3 == 0 else i % 20, t, float(i % 7)) for i, t in enumerate(times(1500, 200))] + [(None, T0, 1.0), (5, None, 2.0)]
    rows += [(99, T0 + dt.timedelta(seconds=600 * k), 1.0) for k in range(20)]        # pauses of exactly the gap
    out = sessions(spark.createDataFrame(rows, "u int, ts timestamp_ntz, v double"), ["u"], 600, sums=["v"], seconds=seconds)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want, by = [], {}
    for u, t, v in rows:
        if t is not None:
            by.setdefault(u, []).append((t, v))
    for u, ts in by.items():
        ts.sort()
        run = [ts[0]]
        for a in ts[1:] + [(dt.datetime(9999, 1, 1), 0.0)]:
            if (a[0] - run[-1][0]).total_seconds() >= 600:
                want.append((u, run[0][0], run[-1][0], len(run), sum(v for _, v in run)))
                run = []
            run.append(a)
    assert got == sorted(want, key=repr)


def test_range_frames_with_peers_and_gaps(spark):
    rows = [("a" if i % 3 else "b", T0 + dt.timedelta(days=RND.randrange(200), hours=RND.choice([0, 0, 12])), None if i % 11 == 0 else float(i)) for i in range(500)]
    rows += [("c", None, 1.0), ("c", T0, None), (None, T0, 4.0)]
    got = {(r.s, r.ts): (r.peers, r.n, r["sum"], r.min, r.max) for r in range_frames(spark.createDataFrame(rows, "s string, ts timestamp_ntz, v double"), ["s"], "v", 20).collect()}
    for s, t in {(s, t) for s, t, _ in rows if t is not None}:
        v = [x for k, u, x in rows if k == s and u is not None and t - dt.timedelta(days=20) <= u <= t and x is not None]
        assert got.pop((s, t)) == (sum(k == s and u == t for k, u, _ in rows), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None))
    assert not got


def test_overlap_join_of_short_and_long_spans(spark):
    def spans(n, extra=()):
        out = []
        for i in range(n):
            a = dt.date(2000, 1, 1) + dt.timedelta(days=RND.randrange(4000))
            out.append((i, RND.choice("xy"), a, a + dt.timedelta(days=RND.choice([0, 0, 1, 5, 40, 3650, -1]))))
        return out + list(extra)
    a = spans(150, [(500, "x", None, dt.date(2001, 1, 1)), (501, None, dt.date(2001, 1, 1), dt.date(2001, 1, 1))])
    b = spans(150, [(500, "x", dt.date(2001, 1, 1), None)])
    x = spark.createDataFrame(a, "i int, k string, a0 date, a1 date")
    y = spark.createDataFrame(b, "j int, k string, b0 date, b1 date")
    meets = lambda p, q: None not in (*p[2:], *q[2:]) and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3]
    got = Counter((r.i, r.j) for r in overlap_join(x, y, ("a0", "a1"), ("b0", "b1")).collect())
    assert got == Counter((p[0], q[0]) for p in a for q in b if meets(p, q)) and max(got.values()) == 1
    got = Counter((r.i, r.j) for r in overlap_join(x, y, ("a0", "a1"), ("b0", "b1"), keys=["k"]).collect())
    assert got == Counter((p[0], q[0]) for p in a for q in b if meets(p, q) and p[1] == q[1] and p[1] is not None)
    assert overlap_join(x.limit(0), y, ("a0", "a1"), ("b0", "b1")).count() == 0


def test_exact_quantiles_of_one_key_that_holds_all_rows(spark):
    v = [RND.choice([RND.random(), 0.25, -3.0]) for _ in range(4000)]
    rows = [("a", x) for x in v] + [("b", 1.5), (None, 2.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    out = quantiles.exact_quantiles(df, ["k"], "v", (0.0, 0.31, 0.5, 1.0), ranges=9)
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    assert set(got) == {"a", "b", None} and got["b"] == (1.5,) * 4 and got[None][2] == 3.0
    assert np.allclose(got["a"], np.quantile(v, (0.0, 0.31, 0.5, 1.0)))
    t = spark.createDataFrame([("a", 1.0), ("a", 5.0)], "symbol string, pnl double")
    assert metrics.pnl_moments(t).first()["median"] == 3.0
    assert "percentile" not in metrics.pnl_moments(t)._jdf.queryExecution().executedPlan().toString()


def test_sketch_states_merge_like_one_sketch(spark, tmp_path):
    v = [RND.gauss(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([(i % 12, x, i // 3) for i, x in enumerate(v)], "m int, v double, item int")
    quantiles.sketch(df, ["m"], "v", "item").write.parquet(f"{tmp_path}/s")
    r = quantiles.estimates(quantiles.merged(spark.read.parquet(f"{tmp_path}/s").withColumn("all", F.lit(1)), ["all"]), ["all"], (0.1, 0.5)).first()
    assert r.n == 20_000 and abs(r.distinct - 6667) < 0.05 * 6667
    assert abs(np.mean(np.array(v) <= r.q10) - 0.1) < 0.02 and abs(np.mean(np.array(v) <= r.q50) - 0.5) < 0.02


def test_rollup_tells_nulls_from_totals(spark):
    t = spark.createDataFrame([("a", "x", 1.0), ("a", None, 2.0), (None, "x", -4.0)], "s string, o string, pnl double")
    got = {(r.s, r.o, r.level): (r.pnl, r.trades, r.wins) for r in metrics.pnl_rollup(t, ["s", "o"]).collect()}
    assert got == {("a", "x", 0): (1.0, 1, 1), ("a", None, 0): (2.0, 1, 1), (None, "x", 0): (-4.0, 1, 0),
                   ("a", None, 1): (3.0, 2, 2), (None, None, 1): (-4.0, 1, 0), (None, None, 3): (-1.0, 3, 2)}


def test_difference_counts_rows_and_prunes_equal_blocks(spark, tmp_path):
    rows = [(s, y, k, float(k % 5), None if k % 9 == 0 else "t") for s in "abc" for y in range(2000, 2006) for k in range(30)]
    other = [r for r in rows if r[:2] != ("b", 2003) or r[2] != 4] + [rows[5], rows[5]] + [("d", 2000, 1, 1.0, "t")]
    schema = "s string, y int, k int, v double, t string"
    stores = []
    for i, data in enumerate((rows, other)):
        spark.createDataFrame(data, schema).write.partitionBy("s", "y").parquet(f"{tmp_path}/{i}")
        stores.append(spark.read.schema("k int, v double, t string, s string, y int").parquet(f"{tmp_path}/{i}"))
    out = difference.difference(*stores, ["s", "y"])
    got = {(r.side, r.times, r.s, r.y, r.k) for r in out.collect()}
    assert got == {("a", 1, "b", 2003, 4), ("b", 2, "a", 2000, 5), ("b", 1, "d", 2000, 1)}
    read = {f.split("/s=")[1].rsplit("/", 1)[0] for f in out.inputFiles()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(((s" in plan.replace("isnotnull", "") or "PartitionFilters" in plan
    assert read and difference.difference(stores[0], stores[0], ["s", "y"]).count() == 0


def test_segment_table_is_read_without_an_exchange(spark, sf, tmp_path, planned):
    bars = resample_bars(ticks_orders(spark, sf))
    t = files.segment_table(bars, "segment_test", f"file://{tmp_path}/t", I.indicator_lookback(20), seg_rows=200)
    try:
        sma = ordered.home(I.windows(t, ["symbol"])).select("symbol", "ts", "vwap_sma20")
        assert not [n for n, _ in nodes(sma) if "Exchange" in n]
        want = I.compute_indicators(bars, fill="none").select("symbol", "ts", "vwap_sma20")
        assert sorted(map(repr, sma.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.sql("DROP TABLE segment_test")


def test_indicators_move_bar_rows_twice(spark, sf, planned):
    bars = I.indexed_bars(resample_bars(ticks_orders(spark, sf)))
    moved = lambda df: [out for n, out in nodes(df) if n == "Exchange" and {"close", "high", "low"} & set(out)]
    assert len(moved(bars)) <= 1                                        # the row index
    halo = I.windows(ordered.halo(bars, back=42), ["symbol"])
    assert len(moved(halo)) - len(moved(bars)) <= 1                     # the halo
    assert not moved(I.compute_raw(bars))                               # the averages, on the rows that were written


def test_averages_go_on_inside_segments(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=2000).cumsum()
    x[rng.random(2000) < 0.05] = np.nan
    x[300:900] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "idx": np.arange(2000), "x": x})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    ref = pd.Series(x).ewm(alpha=1 / 14, adjust=False).mean().to_numpy()
    for seg_rows, block_rows, fan in ((100, 7, 3), (64, 64, 2), (5000, 512, 256)):
        out = with_ewm(ordered.segment(df, "idx", seg_rows), ["k"], {"y": "x"}, 1 / 14, block_rows=block_rows, fan=fan).orderBy("idx").toPandas()
        assert np.nanmax(np.abs(out["y"].to_numpy(dtype=float) - ref)) < 1e-10
    before = spark.createDataFrame([("a", float(ref[1199]), int(np.flatnonzero(~np.isnan(x[:1200]))[-1]))], "k string, _y_y double, _l_y bigint")
    out = with_ewm(ordered.segment(df.where("idx >= 1200"), "idx", 300), ["k"], {"y": "x"}, 1 / 14, before=before).orderBy("idx").toPandas()
    assert np.nanmax(np.abs(out["y"].to_numpy(dtype=float) - ref[1200:])) < 1e-10


def test_appends_equal_one_run(spark, sf, tmp_path):
    bars = resample_bars(ticks_orders(spark, sf)).where("symbol in ('1-URGENT', '2-HIGH')")
    bars = spark.createDataFrame(bars.orderBy("ts").collect(), bars.schema)
    days = [r.ts for r in bars.select("ts").distinct().orderBy("ts").collect()]
    cuts = [days[0], *(days[len(days) * k // 4] for k in range(1, 4)), days[-1] + dt.timedelta(days=1)]
    cuts[2] = cuts[1] + dt.timedelta(days=1)             # a batch of one day
    path = f"file://{tmp_path}/resumed"
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = bars.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
        if n == 2:
            part = part.where("symbol = '1-URGENT'")      # a key may be absent from a batch
            bars = bars.where(~((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)) & (F.col("symbol") == "2-HIGH")))
        resume.append(spark, path, part, n, seg_rows=500)
    resume.append(spark, path, bars.where(F.col("ts") >= F.lit(cuts[3])), 3, seg_rows=500)   # again
    cols = ["symbol", "ts", "idx", *I.RAW_COLUMNS]
    got = resume.stored(spark, path).select(*cols).orderBy("symbol", "ts").toPandas()
    want = I.compute_raw(bars).select(*cols).orderBy("symbol", "ts").toPandas()
    assert got[["symbol", "ts", "idx"]].equals(want[["symbol", "ts", "idx"]])
    for c in I.RAW_COLUMNS:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        assert (np.isnan(a) == np.isnan(b)).all() and np.nanmax(np.abs(a - b)) < 1e-8, c
    with pytest.raises(ValueError, match="not later"):
        resume.append(spark, path, bars.where(F.col("ts") < F.lit(cuts[1])), 4)


def test_indicator_written_outside_the_package(spark, sf):
    @custom.indicator("my_sma", ["vwap"], look_back=19)
    def my_sma(vwap):
        return pd.Series(vwap).rolling(20).mean().to_numpy()

    bars = resample_bars(ticks_orders(spark, sf))
    got = custom.with_indicators(bars, ["my_sma"], rows=150).orderBy("symbol", "idx").toPandas()
    want = I.compute_raw(bars).orderBy("symbol", "idx").toPandas()
    a, b = got["my_sma"].to_numpy(dtype=float), want["vwap_sma20"].to_numpy(dtype=float)
    assert len(a) == len(b) and (np.isnan(a) == np.isnan(b)).all() and np.nanmax(np.abs(a - b)) < 1e-9


def test_stream_stopped_and_started_again(spark, sf, tmp_path):
    ticks = ticks_events(spark, sf).withColumn("f", F.expr("CAST(floor((day(ts) - 1) / 8) AS INT) + CASE WHEN seq % 9 = 0 THEN 2 ELSE 0 END")).cache()
    tables = []
    for stops in ((5,), (1, 5)):
        out = f"file://{tmp_path}/{len(stops)}"
        for k in range(6):
            ticks.where(F.col("f") == k).drop("f").coalesce(1).write.mode("append").parquet(f"{out}/in")
            if k in stops:
                bars, late = resample_stream(spark, f"{out}/in", ticks.drop("f").schema, out, 3600, 86_400)
        tables.append((sorted(map(repr, bars.collect())), sorted(map(repr, late.collect()))))
        rows = bars
    assert tables[0] == tables[1] and tables[0][1]
    # bars and late rows together are the batch's ticks of closed buckets
    top = rows.agg(F.max("ts")).first()[0]
    whole = resample_seconds(ticks.join(late.select("seq"), "seq", "left_anti"), 3600).where(F.col("ts") <= F.lit(top))
    assert sorted(repr((r.symbol, r.ts, r.open, r.close, r.high)) for r in rows.collect()) == sorted(repr((r.symbol, r.ts, r.open, r.close, r.high)) for r in whole.collect())
    ticks.unpersist()


def test_stream_batches_of_several_files(spark, sf, tmp_path):
    """An arrival in three files, also one with a single row or none, is one batch, as in one file."""
    ticks = ticks_events(spark, sf).withColumn("f", F.expr("CASE WHEN seq = 7 THEN 3 ELSE CAST(floor((day(ts) - 1) / 8) AS INT) + CASE WHEN seq % 9 = 0 THEN 2 ELSE 0 END END"))
    ticks = ticks.where("f not in (1, 3) or seq = 7").repartition(8).cache()
    tables = []
    for files_each in (1, 3):
        out = f"file://{tmp_path}/{files_each}"
        for k in range(6):
            append_arrival(ticks.where(F.col("f") == k).drop("f"), f"{out}/in", files_each)
            assert len(spark.read.parquet(f"{out}/in").inputFiles()) == (k + 1) * files_each
            if k in (2, 5):
                bars, late = resample_stream(spark, f"{out}/in", ticks.drop("f").schema, out, 3600, 86_400, files=files_each)
        rounded = lambda df: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
        tables.append((rounded(bars), rounded(late)))
    assert tables[0] == tables[1] and all(tables[0])
    ticks.unpersist()


def test_stream_input_is_written_without_sorts_in_one_task(spark, sf, monkeypatch):
    """The rows of an arrival come from a scan, not from a chain of sorted join partitions."""
    from barspark import registry_series
    plans = []

    def put(ticks, source, parts):
        plans.append([n for n, _ in nodes(ticks)])
        append_arrival(ticks, source, parts)

    monkeypatch.setattr(registry_series, "append_arrival", put)
    monkeypatch.setattr(registry_series, "STREAM_ROWS", 40)
    registry_series.q_stream(spark, sf)
    assert len(plans) == 8 and not any("Join" in n or n in ("Sort", "Exchange", "AdaptiveSparkPlan") for p in plans for n in p)
