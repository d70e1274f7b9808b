"""CSV files by header, directory ingest and incremental ingest."""

from __future__ import annotations

import datetime as dt

import pytest

from barspark.operators import catalog
from barspark.sources import files, ingest
from barspark.streaming.incremental import ingest_incremental


def write(folder, **named):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in named.items():
        (folder / f"{name}.csv").write_text(text)
    return f"file://{folder}"


def test_columns_go_by_name(spark, tmp_path):
    root = write(tmp_path / "a", one="timestamp,open,high\n2024-01-01,1,2\n", two=' High ,"OPEN",Timestamp,note\n4,3,1/2/2024,"x,y"\nNaN,bad,oops,\n')
    got = {(r.open, r.high, r.timestamp, r.note) for r in files.scan_csv_bars(spark, f"{root}/*.csv").collect()}
    assert got == {(1.0, 2.0, dt.datetime(2024, 1, 1), None), (3.0, 4.0, dt.datetime(2024, 1, 2), "x,y"), (None, None, None, None)}


def test_directory_takes_or_reports_every_file(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume\n"
    row = "2024-01-01 09:30:00.5,1,2,0.5,1.5,10\n"
    root = write(tmp_path / "b", AAPL_1d=head + row + row, MSFT_1h="symbol,timestamp,volume,close,low,high,open\nZ,2024-01-01T09:30:00Z,10,1.5,0.5,2,1\n",
                 NOVOL_1d="timestamp,open,high,low,close\n2024-01-01,1,1,1,1\n", NOHEAD_1d="2024-01-01,1,2,3,4,5\n2024-01-02,1,2,3,4,5\n", EMPTY_1d=head)
    write(tmp_path / "b" / "file=GOOG_1d", **{"part-0": head + row, "part-1": head + row})
    bars, report = files.ingest_directory(spark, root)
    assert sorted((r.symbol, r.open, r.close) for r in bars.collect()) == [("AAPL", 1.0, 1.5)] * 2 + [("GOOG", 1.0, 1.5)] * 2 + [("MSFT", 1.0, 1.5)]
    assert {r.symbol: r.status[:8] for r in report.collect()} == {"AAPL": "ok", "MSFT": "ok", "GOOG": "ok", "NOVOL": "missing:", "NOHEAD": "missing:", "EMPTY": "ok"}
    with pytest.raises(ValueError):
        files.ingest_directory(spark, root, "nothing*")


def test_incremental_second_call_reads_new_files_only(spark, tmp_path):
    src = write(tmp_path / "in", a="symbol,timestamp,open\nA,2024-01-01,1\n")
    args = (f"file://{tmp_path}/t", f"file://{tmp_path}/c")
    assert ingest_incremental(spark, src, *args).count() == 1
    write(tmp_path / "in", b="open,symbol,timestamp\n2,B,2024-01-02\n")
    got = ingest_incremental(spark, src, *args)
    assert {(r.symbol, r.open) for r in got.collect()} == {("A", 1.0), ("B", 2.0)}
    assert ingest_incremental(spark, src, *args).count() == 2


def test_second_ingest_keeps_other_data_sets(spark, tmp_path):
    root, cat = f"file://{tmp_path}/bars", f"file://{tmp_path}/catalog"
    bars = lambda symbol, n: spark.createDataFrame([(symbol, dt.datetime(2024, 1, k + 1), 1.0) for k in range(n)], "symbol string, ts timestamp_ntz, close double")
    ingest.ingest_frame(spark, bars("A", 3), "1d", root, cat)
    ingest.ingest_frame(spark, bars("B", 2), "1d", root, cat)
    ingest.ingest_frame(spark, bars("A", 4), "1h", root, cat)
    rows = lambda: {(r.symbol, r.timeframe): r["count"] for r in files.scan_parquet_bars(spark, root).groupBy("symbol", "timeframe").count().collect()}
    assert rows() == {("A", "1d"): 3, ("B", "1d"): 2, ("A", "1h"): 4}
    known = {r.file_path: (r.file_size_bytes, r.checksum) for r in catalog.snapshot(spark, cat, "datasets").collect()}
    assert known == {r.file_path: (r.file_size_bytes, r.checksum) for r in ingest.stored_folders(spark, root).collect()} and len(known) == 3
    # the same range again replaces its data set, another range is one of its own
    again = bars("B", 2).where("ts > '2024-01-01'").unionByName(bars("B", 1)).unionByName(bars("B", 1))
    ingest.ingest_frame(spark, again, "1d", root, cat, description="twice")
    ingest.ingest_frame(spark, bars("B", 1), "1d", root, cat)
    assert rows() == {("A", "1d"): 3, ("B", "1d"): 4, ("A", "1h"): 4}
    facts = lambda: sorted((r.file_path, r.row_count, r.file_size_bytes, r.checksum) for r in catalog.snapshot(spark, cat, "datasets").collect())
    stored = {r.file_path: (r.file_size_bytes, r.checksum) for r in ingest.stored_folders(spark, root).collect()}
    assert {f[0]: f[2:] for f in facts()} == stored and [f[1] for f in facts() if "symbol=B" in f[0]] == [1, 3]
    # a batch reads its own folders only: the files of another data set may even be unreadable
    broken = next(p for p in (tmp_path / "bars" / "symbol=A" / "timeframe=1h").rglob("*.parquet"))
    broken.write_bytes(b"not parquet")
    ingest.ingest_frame(spark, bars("C", 2), "1d", root, cat)
    assert len(facts()) == 5
    # an unfinished commit is not seen
    (tmp_path / "catalog" / "v=99" / "symbols").mkdir(parents=True)
    assert len(facts()) == 5
