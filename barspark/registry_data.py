"""Queries over validation/cleaning, the dataset catalog, the stored bars,
files and streams, the run store, and the presentation-side metric views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from . import oracle as O
from . import params as P
from .operators import catalog as C
from .operators import metrics, quality, runs
from .operators.bars import bars_latest, bars_range, bars_resampled, top_rows
from .operators.resample import resample_seconds
from .registry import finalize, memo, register
from .registry_core import DEFAULT, daily_bars, result
from .session import cut_lineage, ts_lit
from .sources import files
from .sources.fixtures import (catalog_datasets, catalog_symbols, dataset_id_expr, dirty_ticks, symbol_id_expr,
                               table, text_id, ticks_events)
from .streaming.incremental import ingest_incremental

r6 = O.r6
dbl = O.dbl
DAILY = O.bars_sql(O.ticks_orders_sql(), 86400)
MINUTE = O.bars_sql(O.ticks_events_sql(), 60)
HOURLY = O.bars_sql(O.ticks_events_sql(), 3600)
BAR6 = ["open", "high", "low", "close", "vwap", "volume"]


def _cols6(cols, prefix=""):
    return ", ".join(f"{r6(prefix + c)} AS {c}" for c in cols)


# --- validation and cleaning on the damaged ticks (F3) ----------------------------
DIRTY = f"""SELECT symbol,
  CASE WHEN seq % 83 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp, seq, p AS open,
  CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 89 = 0 THEN p - 0.5 ELSE p + 0.5 END AS high,
  CASE WHEN seq % 89 = 0 THEN p + 0.5 ELSE p - 0.5 END AS low, p AS close, p AS vwap, volume
  FROM ({O.ticks_orders_sql()}) t"""
PROFILE = f"""WITH d AS ({DIRTY}), prof AS (SELECT symbol, count(*) AS row_count,
    count(*) FILTER (WHERE try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') IS NULL) AS invalid_timestamps,
    min(try_strptime(timestamp, '%Y-%m-%d %H:%M:%S')) AS ts_min, max(try_strptime(timestamp, '%Y-%m-%d %H:%M:%S')) AS ts_max,
    count(*) - count(DISTINCT timestamp) AS duplicate_timestamps,
    count(*) FILTER (WHERE high < low) AS inverted_bars,
    {", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in ["open", "high", "low", "close", "vwap"])}
  FROM d GROUP BY symbol)"""


def _dirty(spark, sf):
    return dirty_ticks(spark, sf)


register("v_min_rows", PROFILE + f" SELECT symbol, row_count, row_count >= {P.MIN_ROWS} AS min_rows_ok FROM prof")(
    lambda spark, sf: finalize(quality.profile(_dirty(spark, sf)).select(
        "symbol", "row_count", (F.col("row_count") >= P.MIN_ROWS).alias("min_rows_ok"))))
register("v_timestamps", PROFILE + " SELECT symbol, invalid_timestamps, ts_min, ts_max FROM prof")(
    lambda spark, sf: finalize(quality.profile(_dirty(spark, sf)).select(
        "symbol", "invalid_timestamps", "ts_min", "ts_max")))
register("v_duplicates", PROFILE + " SELECT symbol, duplicate_timestamps FROM prof")(
    lambda spark, sf: finalize(quality.profile(_dirty(spark, sf)).select("symbol", "duplicate_timestamps")))
_NULLS = [f"{c}_nulls" for c in ["open", "high", "low", "close", "vwap"]]
register("v_null_profile", PROFILE + f" SELECT symbol, {', '.join(_NULLS)} FROM prof")(
    lambda spark, sf: finalize(quality.profile(_dirty(spark, sf)).select("symbol", *_NULLS)))
register("v_inverted_bars", PROFILE + " SELECT symbol, inverted_bars FROM prof")(
    lambda spark, sf: finalize(quality.profile(_dirty(spark, sf)).select("symbol", "inverted_bars")))

_ERR = ", ".join([f"CASE WHEN row_count < {P.MIN_ROWS} THEN printf('Insufficient data: %d rows (minimum {P.MIN_ROWS} "
                  f"required)', row_count) END",
                  "CASE WHEN invalid_timestamps = row_count THEN 'No valid timestamps found' END"]
                 + [f"CASE WHEN {c}_nulls = row_count THEN 'Column ''{c}'' contains all NaN values' END"
                    for c in ["open", "high", "low", "close", "vwap"]])
_WARN = ", ".join(["CASE WHEN invalid_timestamps > 0 THEN printf('%d invalid timestamps will be dropped', "
                   "invalid_timestamps) END",
                   "CASE WHEN duplicate_timestamps > 0 THEN printf('%d duplicate timestamps will be deduplicated', "
                   "duplicate_timestamps) END"]
                  + [f"CASE WHEN {c}_nulls > 0 AND {c}_nulls < row_count THEN printf('Column ''{c}'' has %d missing "
                     f"values', {c}_nulls) END" for c in ["open", "high", "low", "close", "vwap"]]
                  + ["CASE WHEN inverted_bars > 0 THEN printf('%d bars have HIGH < LOW (will be corrected)', "
                     "inverted_bars) END"])


@register("validation_report", PROFILE + f""" SELECT symbol, concat_ws('; ', {_ERR}) = '' AS is_valid,
  concat_ws('; ', {_ERR}) AS errors, concat_ws('; ', {_WARN}) AS warnings, row_count, ts_min, ts_max FROM prof""")
def q_validation(spark, sf):
    v = quality.validation_report(_dirty(spark, sf))
    return finalize(v.select("symbol", "is_valid", F.array_join("errors", "; ").alias("errors"),
                             F.array_join("warnings", "; ").alias("warnings"), "row_count", "ts_min", "ts_max"))


@register("clean_bars", f"""WITH d AS ({DIRTY}),
  t AS (SELECT *, try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts FROM d),
  f AS (SELECT * FROM t WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) = 1)
  SELECT symbol, ts, seq, {r6('open')} AS open, {r6('CASE WHEN high < low THEN low ELSE high END')} AS high,
    {r6('CASE WHEN high < low THEN high ELSE low END')} AS low, {r6('close')} AS close, {r6('vwap')} AS vwap,
    {r6('volume')} AS volume
  FROM f WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND vwap IS NOT NULL""")
def q_clean(spark, sf):
    return finalize(quality.clean_bars(_dirty(spark, sf)))


# --- catalog (F5) -----------------------------------------------------------------
def _sid(col):
    return f"CAST('0x' || substr(md5({col}), 1, 13) AS BIGINT)"


def _did(symbol, timeframe, part):
    return _sid(f"{symbol} || '|' || {timeframe} || '|' || CAST({part} AS VARCHAR)")


SYMBOLS_SQL = f"""SELECT {_sid('symbol')} AS symbol_id, symbol, asset_type, vendor, 'derived symbol ' || symbol AS description,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM (
  SELECT DISTINCT o_orderpriority AS symbol, 'equity' AS asset_type, 'orders' AS vendor FROM orders
  UNION ALL SELECT DISTINCT event_type, 'crypto', 'events' FROM events
  UNION ALL SELECT DISTINCT r_name, 'index', 'region' FROM region) s"""
DATASETS_SQL = f"""SELECT {_did('symbol', 'timeframe', 'part')} AS dataset_id,
  {_sid('symbol')} AS symbol_id, timeframe, strftime(t0, '%Y-%m-%d') AS start_date, strftime(t1, '%Y-%m-%d') AS end_date,
  row_count, 'bars/' || replace(replace(symbol, '/', '_'), ':', '_') || '_' || timeframe || '_' || strftime(t0, '%Y-%m-%d')
    || '_' || strftime(t1, '%Y-%m-%d') || '.parquet' AS file_path,
  row_count * 48 + 4096 AS file_size_bytes, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM (
  SELECT symbol, timeframe, part, min(ts) AS t0, max(ts) AS t1, count(*) AS row_count FROM (
    SELECT o_orderpriority AS symbol, '1d' AS timeframe, year(o_orderdate) AS part, o_orderdate AS ts FROM orders
    UNION ALL SELECT event_type, '1min', CAST(floor((day(ts) - 1) / 10) AS INTEGER), ts FROM events) u
  GROUP BY symbol, timeframe, part) g"""
CAT = f"WITH symbols AS ({SYMBOLS_SQL}), datasets AS ({DATASETS_SQL})"


def _cat(spark, sf):
    return catalog_symbols(spark, sf), catalog_datasets(spark, sf)


def _mb(e):
    return f"round(CAST({e} AS DOUBLE) / 1024.0 / 1024.0, 2)"


register("list_datasets", CAT + """ SELECT d.*, s.symbol, s.asset_type FROM datasets d
  JOIN symbols s USING (symbol_id)""")(
    lambda spark, sf: finalize(C.list_datasets(_cat(spark, sf)[1], _cat(spark, sf)[0])))

register("list_symbols", CAT + f""" SELECT symbol, asset_type, vendor, count(DISTINCT dataset_id) AS dataset_count,
  count(DISTINCT timeframe) AS timeframe_count, min(start_date) AS earliest_date, max(end_date) AS latest_date,
  CAST(coalesce(sum(row_count), 0) AS BIGINT) AS total_rows, {_mb('coalesce(sum(file_size_bytes), 0)')} AS total_size_mb
  FROM symbols LEFT JOIN datasets USING (symbol_id) GROUP BY symbol, asset_type, vendor""")(
    lambda spark, sf: finalize(C.list_symbols(*_cat(spark, sf))))

register("timeframes_for_symbol", CAT + """ SELECT DISTINCT symbol, timeframe FROM datasets
  JOIN symbols USING (symbol_id)""")(lambda spark, sf: finalize(C.timeframes_for_symbol(*_cat(spark, sf))))

RANGE = ("1996-01-01", "1998-12-31")
register("prune_datasets", CAT + f""" SELECT * FROM datasets
  WHERE NOT (end_date < '{RANGE[0]}') AND NOT (start_date > '{RANGE[1]}')""")(
    lambda spark, sf: finalize(C.overlapping(_cat(spark, sf)[1], *RANGE)))

register("date_range_summary", CAT + f""" SELECT symbol, timeframe, CAST(sum(row_count) AS BIGINT) AS total_rows,
  count(*) AS dataset_count, min(start_date) AS start_date, max(end_date) AS end_date,
  {_mb('sum(file_size_bytes)')} AS total_size_mb FROM datasets JOIN symbols USING (symbol_id)
  WHERE NOT (end_date < '{RANGE[0]}') AND NOT (start_date > '{RANGE[1]}') GROUP BY symbol, timeframe""")(
    lambda spark, sf: finalize(C.date_range_summary(*_cat(spark, sf), *RANGE)))

register("catalog_orphans", CAT + """ SELECT 'dataset_without_symbol' AS kind, dataset_id AS id, file_path AS name
  FROM datasets WHERE symbol_id NOT IN (SELECT symbol_id FROM symbols)
  UNION ALL SELECT 'symbol_without_dataset', symbol_id, symbol FROM symbols
  WHERE symbol_id NOT IN (SELECT symbol_id FROM datasets)""")(
    lambda spark, sf: finalize(C.orphans(*_cat(spark, sf))))

# updates: every event type re-labelled, plus the return flags of lineitem as new symbols
UPD_TS = "2024-06-01 00:00:00"


def _updates(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol")).distinct() \
        .withColumn("asset_type", F.lit("derivative")).withColumn("vendor", F.lit("events-v2"))
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol")).distinct() \
        .withColumn("asset_type", F.lit("commodity")).withColumn("vendor", F.lit("lineitem"))
    u = e.unionByName(li)
    t = ts_lit(UPD_TS)
    return u.select(symbol_id_expr("symbol").alias("symbol_id"), "symbol", "asset_type", "vendor",
                    F.concat(F.lit("updated symbol "), F.col("symbol")).alias("description"),
                    t.alias("created_at"), t.alias("updated_at"))


UPD_SQL = f"""SELECT {_sid('symbol')} AS symbol_id, symbol, asset_type, vendor, 'updated symbol ' || symbol AS description,
  TIMESTAMP '{UPD_TS}' AS created_at, TIMESTAMP '{UPD_TS}' AS updated_at FROM (
  SELECT DISTINCT event_type AS symbol, 'derivative' AS asset_type, 'events-v2' AS vendor FROM events
  UNION ALL SELECT DISTINCT l_returnflag, 'commodity', 'lineitem' FROM lineitem) u"""
register("upsert_symbol", CAT + f""", n AS ({UPD_SQL}) SELECT coalesce(o.symbol_id, n.symbol_id) AS symbol_id,
  coalesce(o.symbol, n.symbol) AS symbol, CASE WHEN n.symbol IS NULL THEN o.asset_type ELSE n.asset_type END AS asset_type,
  CASE WHEN n.symbol IS NULL THEN o.vendor ELSE n.vendor END AS vendor,
  CASE WHEN n.symbol IS NULL THEN o.description ELSE n.description END AS description,
  coalesce(o.created_at, n.created_at) AS created_at, CASE WHEN n.symbol IS NULL THEN o.updated_at ELSE n.updated_at END AS updated_at
  FROM symbols o FULL OUTER JOIN n ON o.symbol = n.symbol""")(
    lambda spark, sf: finalize(C.upsert_symbols(_cat(spark, sf)[0], _updates(spark, sf))))


def _new_datasets(spark, sf):
    """A second batch: lineitem ship dates per (return flag, year) as '1d'
    (those of 'N' given twice, under a second id) plus a re-registration of
    the existing 1995 order datasets."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").alias("ts"))
    g = li.groupBy("symbol", F.year("ts").alias("part")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"),
                                                             F.count(F.lit(1)).alias("row_count"))
    start, end = F.date_format("t0", "yyyy-MM-dd"), F.date_format("t1", "yyyy-MM-dd")
    fresh = g.select(dataset_id_expr("symbol", F.lit("1d"), F.col("part")).alias("dataset_id"),
                     symbol_id_expr("symbol").alias("symbol_id"), F.lit("1d").alias("timeframe"),
                     start.alias("start_date"), end.alias("end_date"), F.col("row_count").cast("long").alias("row_count"),
                     F.concat(F.lit("bars/"), F.col("symbol"), F.lit("_1d_"), start, F.lit("_"), end,
                              F.lit(".parquet")).alias("file_path"),
                     (F.col("row_count") * F.lit(48) + F.lit(4096)).cast("long").alias("file_size_bytes"),
                     ts_lit(UPD_TS).alias("created_at"))
    again = catalog_datasets(spark, sf).filter(F.col("start_date").startswith("1995"))
    twice = fresh.where(F.col("symbol_id") == text_id(F.lit("N"))).withColumn("dataset_id", F.lit(1 << 52))
    return fresh.unionByName(twice).unionByName(again)


NEW_DS_SQL = f"""SELECT {_did('symbol', "'1d'", 'part')} AS dataset_id, {_sid('symbol')} AS symbol_id,
  '1d' AS timeframe, strftime(t0, '%Y-%m-%d') AS start_date, strftime(t1, '%Y-%m-%d') AS end_date, row_count,
  'bars/' || symbol || '_1d_' || strftime(t0, '%Y-%m-%d') || '_' || strftime(t1, '%Y-%m-%d') || '.parquet' AS file_path,
  row_count * 48 + 4096 AS file_size_bytes, TIMESTAMP '{UPD_TS}' AS created_at FROM (
  SELECT l_returnflag AS symbol, year(l_shipdate) AS part, min(l_shipdate) AS t0, max(l_shipdate) AS t1,
    count(*) AS row_count FROM lineitem GROUP BY l_returnflag, year(l_shipdate)) g
  UNION ALL SELECT * FROM datasets WHERE starts_with(start_date, '1995')"""
register("register_dataset", CAT + f""", n AS ({NEW_DS_SQL}) SELECT * FROM datasets
  UNION ALL SELECT * FROM n WHERE file_path NOT IN (SELECT file_path FROM datasets)""")(
    lambda spark, sf: finalize(C.register_datasets(_cat(spark, sf)[1], _new_datasets(spark, sf))))

register("delete_dataset", CAT + """ SELECT * FROM datasets WHERE dataset_id NOT IN
  (SELECT dataset_id FROM datasets WHERE end_date < '1995-01-01')""")(
    lambda spark, sf: finalize(C.delete_datasets(
        _cat(spark, sf)[1], _cat(spark, sf)[1].filter(F.col("end_date") < "1995-01-01"))))


# --- stored bars (2.3) ---------------------------------------------------------------
def _store_bars(spark, sf):
    d = daily_bars(spark, sf).withColumn("timeframe", F.lit("1d"))
    m = resample_seconds(ticks_events(spark, sf), 60).withColumn("timeframe", F.lit("1min"))
    return d.unionByName(m)


def store(spark, sf):
    """The stored table: Parquet partitioned by symbol and timeframe."""
    return files.scan_parquet_bars(spark, _store_path(spark, sf))


STORE_SQL = f"SELECT *, '1d' AS timeframe FROM ({DAILY}) a UNION ALL SELECT *, '1min' FROM ({MINUTE}) b"
MIN_RANGE = ("2024-01-03", "2024-01-15")

register("bars_range", f"""SELECT symbol, ts, {r6('close')} AS close, {r6('volume')} AS volume FROM ({STORE_SQL}) s
  WHERE timeframe = '1min' AND ts >= TIMESTAMP '{MIN_RANGE[0]}' AND ts <= TIMESTAMP '{MIN_RANGE[1]}'""")(
    lambda spark, sf: finalize(bars_range(store(spark, sf), "1min", None, *MIN_RANGE, columns=["close", "volume"])))

register("bars_latest", CAT + f""", latest AS (SELECT symbol, arg_max(start_date, end_date) AS s, max(end_date) AS e
    FROM datasets JOIN symbols USING (symbol_id) WHERE timeframe = '1d' GROUP BY symbol),
  b AS (SELECT st.* FROM ({STORE_SQL}) st JOIN latest l USING (symbol)
    WHERE timeframe = '1d' AND strftime(ts, '%Y-%m-%d') >= s AND strftime(ts, '%Y-%m-%d') <= e
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100)
  SELECT symbol, ts, {_cols6(BAR6)}, timeframe FROM b""")(
    lambda spark, sf: finalize(bars_latest(store(spark, sf), catalog_datasets(spark, sf), catalog_symbols(spark, sf),
                                           "1d", 100)))

register("bars_resampled", f"""SELECT symbol, bucket AS ts, {r6('first(open ORDER BY ts)')} AS open,
  {r6('max(high)')} AS high, {r6('min(low)')} AS low, {r6('first(close ORDER BY ts DESC)')} AS close,
  {r6('coalesce(sum(volume), 0.0)')} AS volume
  FROM (SELECT *, time_bucket(INTERVAL '900 seconds', ts) AS bucket FROM ({STORE_SQL}) s
        WHERE timeframe = '1min' AND ts >= TIMESTAMP '{MIN_RANGE[0]}' AND ts <= TIMESTAMP '{MIN_RANGE[1]}') x
  GROUP BY symbol, bucket""")(
    lambda spark, sf: finalize(bars_resampled(store(spark, sf), "1min", "15min", *MIN_RANGE)))

register("head_preview", f"""SELECT symbol, ts, {_cols6(BAR6)} FROM ({DAILY}) b
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) <= 10""")(
    lambda spark, sf: finalize(top_rows(daily_bars(spark, sf), 10)))
register("tail_rows", f"""SELECT symbol, ts, {_cols6(BAR6)} FROM ({DAILY}) b
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {P.MAX_TABLE_ROWS}""")(
    lambda spark, sf: finalize(top_rows(daily_bars(spark, sf), P.MAX_TABLE_ROWS, latest=True)))


# --- files, sinks and streams (2.1) -------------------------------------------------
def _daily_csv_frame(spark, sf, odd_headers=True):
    b = daily_bars(spark, sf)
    names = {"timestamp": " Timestamp ", "open": "OPEN", "high": "High ", "low": " low", "close": "Close",
             "vwap": "VWAP", "volume": "Volume"} if odd_headers else {}
    cols = [F.col("symbol")] + [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(names.get("timestamp", "timestamp"))]
    cols += [F.col(c).alias(names.get(c, c)) for c in BAR6]
    return b.select(*cols)


def _daily_csv(spark, sf, odd_headers=True):
    def build():
        return files.write_csv(_daily_csv_frame(spark, sf, odd_headers), files.scratch(spark, "daily-csv"))
    return memo(spark, ("csv", sf, odd_headers), build)


DAILY6 = f"SELECT symbol, ts AS timestamp, {_cols6(BAR6)} FROM ({DAILY}) b"
register("scan_csv_bars", DAILY6)(
    lambda spark, sf: finalize(files.scan_csv_bars(spark, _daily_csv(spark, sf))))


def _blackout_text(spark, sf):
    """Blackout file derived from orders: a date line per partially filled
    order (two date formats), a comment per priority, blank and junk lines."""
    def build():
        o = table(spark, sf, "orders")
        us = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        dates = o.filter(F.col("o_orderstatus") == "P").select(
            F.when(us, F.date_format("o_orderdate", "MM/dd/yyyy"))
             .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("value"))
        notes = o.select(F.concat(F.lit("# priority "), F.col("o_orderpriority")).alias("value")).distinct()
        blank = o.select(F.lit("   ").alias("value"), "o_orderstatus").distinct().select("value")
        junk = o.select(F.concat(F.lit("TBD "), F.col("o_orderstatus")).alias("value")).distinct()
        path = files.scratch(spark, "blackout-txt")
        dates.unionByName(notes).unionByName(blank).unionByName(junk).write.mode("overwrite").text(path)
        return path
    return memo(spark, ("blackout-txt", sf), build)


register("scan_blackout_dates", "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS event_date FROM orders "
                                "WHERE o_orderstatus = 'P'")(
    lambda spark, sf: finalize(files.scan_blackout_dates(spark, _blackout_text(spark, sf))))


def _store_path(spark, sf):
    return memo(spark, ("store", sf), lambda: files.sink_parquet_bars(_store_bars(spark, sf), files.scratch(spark, "store")))


STORE6 = f"SELECT symbol, timeframe, ts, {_cols6(BAR6)} FROM ({STORE_SQL}) s"
register("sink_parquet_bars", STORE6)(
    lambda spark, sf: finalize(files.scan_parquet_bars(spark, _store_path(spark, sf))))
register("scan_parquet_bars", f"SELECT symbol, timeframe, ts, {r6('close')} AS close FROM ({STORE_SQL}) s "
                              "WHERE timeframe = '1d'")(
    lambda spark, sf: finalize(files.scan_parquet_bars(spark, _store_path(spark, sf), ["symbol", "timeframe", "ts", "close"])
                               .filter(F.col("timeframe") == "1d")))

register("profile_dataset", f"""SELECT symbol, timeframe, strftime(min(ts), '%Y-%m-%d') AS start_date,
  strftime(max(ts), '%Y-%m-%d') AS end_date, count(*) AS row_count FROM ({STORE_SQL}) s GROUP BY symbol, timeframe""")(
    lambda spark, sf: finalize(store(spark, sf).groupBy("symbol", "timeframe").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("end_date"), F.count(F.lit(1)).alias("row_count"))))

#: Batches of an ingest: two disjoint ranges, one that overlaps both, and the first once more with other prices.
INGEST_PARTS = ("ts < TIMESTAMP '1998-01-01'", "ts >= TIMESTAMP '1998-01-01'", "ts >= TIMESTAMP '1997-06-01' AND ts < TIMESTAMP '1998-06-01'")
INGEST_SQL = f"""WITH b AS ({DAILY}), p AS ({" UNION ALL ".join(f"SELECT {n} AS part, * FROM b WHERE {w}" for n, w in enumerate(INGEST_PARTS))}),
  d AS (SELECT symbol, strftime(min(ts), '%Y-%m-%d') AS start_date, strftime(max(ts), '%Y-%m-%d') AS end_date, count(*) AS row_count FROM p GROUP BY symbol, part)
  SELECT symbol, 'equity' AS asset_type, 'csv_import' AS vendor, '1d' AS timeframe, start_date, end_date, row_count,
  'symbol=' || symbol || '/timeframe=1d/dates=' || start_date || '_' || end_date AS folder, true AS complete FROM d"""


def ingest_query(spark, bars, **kw):
    """Ingest every symbol several times into one root (``INGEST_PARTS``), one range a second time
    with other prices, then read the committed catalog back; ``complete``: the registered
    folder exists with the registered size and checksum and holds the registered rows."""
    from .sources import ingest
    root, catalog_path = files.scratch(spark, "ingest"), files.scratch(spark, "catalog")
    for part in (INGEST_PARTS[0], *INGEST_PARTS):
        batch = bars.where(part.replace("TIMESTAMP ", "TIMESTAMP_NTZ "))
        other = part == INGEST_PARTS[0] and not C.snapshot(spark, catalog_path, "datasets").take(1)
        ingest.ingest_frame(spark, batch.withColumn("close", F.col("close") + 1) if other else batch, "1d", root, catalog_path, **kw)
    ingest.ingest_frame(spark, bars, "1d", root, catalog_path, write=False, **kw)     # known files: no second row
    d, s = C.snapshot(spark, catalog_path, "datasets"), C.snapshot(spark, catalog_path, "symbols")
    found = ingest.stored_folders(spark, root).select(F.col("file_path"), F.col("file_size_bytes").alias("size"), F.col("checksum").alias("sum"))
    name = lambda c: F.regexp_extract(c, "([^/]*/[^/]*/[^/]*)$", 1)
    rows = spark.read.schema(files.DATED_SCHEMA).parquet(root).groupBy("symbol", "timeframe", "dates").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("dates", F.concat(F.lit("dates="), "dates"))
    j = d.join(s.select("symbol_id", "symbol", "asset_type", "vendor"), "symbol_id").join(found, "file_path", "left")
    j = j.withColumn("dates", F.regexp_extract("file_path", "([^/]*)$", 1)).join(rows, ["symbol", "timeframe", "dates"], "left")
    ok = (F.col("size") == F.col("file_size_bytes")) & (F.col("sum") == F.col("checksum")) & (F.col("n") == F.col("row_count"))
    return finalize(j.select("symbol", "asset_type", "vendor", "timeframe", "start_date", "end_date", "row_count",
                             name("file_path").alias("folder"), F.coalesce(ok, F.lit(False)).alias("complete")))


register("ingest_frame", INGEST_SQL)(lambda spark, sf: ingest_query(spark, daily_bars(spark, sf)))


@register("ingest_csv", INGEST_SQL)
def q_ingest_csv(spark, sf):
    b = files.scan_csv_bars(spark, _daily_csv(spark, sf)).withColumnRenamed("timestamp", "ts")
    return ingest_query(spark, b.filter(F.col("ts").isNotNull()))


def _ingest_dir(spark, sf):
    def build():
        root = files.scratch(spark, "ingest-dir")
        b = daily_bars(spark, sf)
        cols = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "open", "high", "low", "close", "volume"]
        # one folder per symbol from ONE partitioned write: <root>/file=<SYMBOL>_1d/part-*.csv
        name = F.concat(F.regexp_replace("symbol", "[^A-Za-z0-9-]", "-"), F.lit("_1d"))
        (b.select(*cols, name.alias("file")).write.mode("overwrite").option("header", True)
          .partitionBy("file").csv(root))
        ev = resample_seconds(ticks_events(spark, sf), 3600)
        files.write_csv(ev.select(cols[0], "open", "high", "low", "close", F.col("volume").alias("vol")),
                        f"{root}/file=EVENTS_1h")
        return root
    return memo(spark, ("ingest-dir", sf), build)


register("ingest_directory", f"""SELECT regexp_replace(symbol, '[^A-Za-z0-9-]', '-', 'g') AS symbol, count(*) AS rows,
  'ok' AS status FROM ({DAILY}) b GROUP BY symbol
  UNION ALL SELECT 'EVENTS', count(*), 'missing: volume' FROM ({HOURLY}) h""")(
    lambda spark, sf: finalize(files.ingest_directory(spark, _ingest_dir(spark, sf))[1]))


@register("ingest_incremental", DAILY6.replace("ts AS timestamp", "ts"))
def q_incremental(spark, sf):
    """Two calls with one checkpoint: the second finds only the files added since."""
    out = files.scratch(spark, "incremental")
    src, args = out + "/in", (out + "/table", out + "/checkpoint")
    rows = _daily_csv_frame(spark, sf, odd_headers=False)
    early = F.col("timestamp") < "1998"
    rows.where(early).write.option("header", True).csv(src)
    ingest_incremental(spark, src, *args)
    rows.where(~early).select("timestamp", "symbol", *BAR6[::-1]).write.mode("append").option("header", True).csv(src)
    t = ingest_incremental(spark, src, *args)
    return finalize(t.select("symbol", "ts", *BAR6))


@register("file_fingerprint", """WITH f AS (SELECT o_orderpriority AS symbol, string_agg(o_orderkey || ',' || o_orderstatus || chr(10), '' ORDER BY o_orderkey) AS body
    FROM orders GROUP BY o_orderpriority)
  SELECT symbol, CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS sha256, substr(sha256(body), 1, 16) AS cache_key FROM f""")
def q_fingerprint(spark, sf):
    """Files of known bytes: the orders of each priority, one line an order."""
    path = files.scratch(spark, "fingerprint")
    o = table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("value"), "o_orderkey", F.col("o_orderpriority").alias("symbol"))
    (o.repartition("symbol").sortWithinPartitions("symbol", "o_orderkey").select("value", "symbol").write.partitionBy("symbol").text(path))
    got = files.file_fingerprint(spark, f"{path}/symbol=*/*.txt")
    name = F.regexp_extract("path", "symbol=([^/]*)/", 1)
    return finalize(got.select(name.alias("symbol"), "length", "sha256", "cache_key"))


# --- exports (formatted, written, read back) ------------------------------------------
def _roundtrip(spark, df, name):
    path = files.write_csv(df, files.scratch(spark, name))
    return spark.read.option("header", True).csv(path)


TRADE_FMT = ["short_put", "long_put", "short_call", "long_call", "net_credit", "expiry_close", "pnl", "cum_pnl"]
_REASONS = ("concat_ws(', ', CASE WHEN NOT cond_hv THEN 'HV outside range' END, CASE WHEN NOT cond_adx THEN "
            "'ADX too high' END, CASE WHEN NOT cond_rsi THEN 'RSI out of range' END, CASE WHEN blackout THEN "
            "'Blackout window' END)")


@register("export_trades_csv", O.daily_backtest_with(DEFAULT) + f""" SELECT symbol,
  strftime(entry_date, '%Y-%m-%d %H:%M:%S') AS entry_date, strftime(expiry_date, '%Y-%m-%d %H:%M:%S') AS expiry_date,
  {", ".join(f"{r6(c)} AS {c}" for c in TRADE_FMT)}, outcome FROM trades""")
def q_export_trades(spark, sf):
    t = result(spark, sf).trades
    f = t.select("symbol", F.date_format("entry_date", P.EXPORT_DATETIME_FORMAT).alias("entry_date"),
                 F.date_format("expiry_date", P.EXPORT_DATETIME_FORMAT).alias("expiry_date"), *TRADE_FMT, "outcome")
    back = _roundtrip(spark, f, "trades-csv")
    return finalize(back.select("symbol", "entry_date", "expiry_date",
                                *[F.col(c).cast("double").alias(c) for c in TRADE_FMT], "outcome"))


@register("export_equity_csv", O.daily_backtest_with(DEFAULT) + f""" SELECT symbol,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, {r6('cash')} AS cash FROM equity""")
def q_export_equity(spark, sf):
    e = result(spark, sf).equity.select("symbol", F.date_format("ts", P.EXPORT_DATETIME_FORMAT).alias("timestamp"),
                                        "cash")
    back = _roundtrip(spark, e, "equity-csv")
    return finalize(back.select("symbol", "timestamp", F.col("cash").cast("double").alias("cash")))


@register("export_rejected_csv", O.daily_backtest_with(DEFAULT) + f""" SELECT symbol,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS date, CASE WHEN {_REASONS} = '' THEN 'Not eligible' ELSE {_REASONS} END
  AS reasons, {r6('adx')} AS adx, {r6('rsi')} AS rsi, {r6('hv')} AS hv, blackout FROM sig WHERE NOT eligible""")
def q_export_rejected(spark, sf):
    r = result(spark, sf).rejected
    f = r.select("symbol", F.date_format("date", P.EXPORT_DATETIME_FORMAT).alias("date"), "reasons", "adx", "rsi",
                 "hv", "blackout")
    back = _roundtrip(spark, f, "rejected-csv")
    return finalize(back.select("symbol", "date", "reasons", *[F.col(c).cast("double").alias(c)
                                                               for c in ("adx", "rsi", "hv")],
                                F.col("blackout").cast("boolean").alias("blackout")))


@register("export_run_json", O.daily_backtest_with(DEFAULT) + O.summary_select() + f""", b AS (SELECT symbol, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM ib GROUP BY symbol)
  SELECT '{P.VERSION}' AS version, true AS named, n AS rows, strftime(t0, '%Y-%m-%d') AS start, strftime(t1, '%Y-%m-%d') AS end, '{DEFAULT.trend_method}' AS trend_method,
    CAST({DEFAULT.hv_max} AS DOUBLE) AS hv_max, s.trades, s.wins, {r6('s.total_pnl')} AS total_pnl, {r6('s.win_rate')} AS win_rate, {r6('s.max_drawdown')} AS max_drawdown
  FROM b JOIN summary s USING (symbol)""")
def q_export_run(spark, sf):
    """One JSON document per symbol run: id, time, version, data, parameters, results; read back (``named``: id and time are there)."""
    s = result(spark, sf).summary
    b = daily_bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"),
                                                     F.max("ts").alias("end"))
    params = F.from_json(F.lit(runs.config_json(DEFAULT)), "map<string,string>")
    doc = F.to_json(F.struct(F.expr("uuid()").alias("run_id"), F.current_timestamp().alias("timestamp"),
                             F.lit(P.VERSION).alias("version"),
                             F.struct("rows", "start", "end").alias("data"), params.alias("parameters"),
                             F.struct(*[c for c in s.columns if c != "symbol"]).alias("results")))
    path = files.scratch(spark, "run-json")
    s.join(b, "symbol").select("symbol", doc.alias("value")).select("value").write.mode("overwrite").text(path)
    back = spark.read.schema("run_id string, timestamp string, version string, data struct<rows: bigint, start: string, end: string>, parameters map<string,string>, "
                             "results struct<trades: bigint, wins: bigint, total_pnl: double, win_rate: double, max_drawdown: double>").json(path)
    return finalize(back.select(
        "version", (F.col("run_id").isNotNull() & F.col("timestamp").isNotNull()).alias("named"), "data.rows", F.substring("data.start", 1, 10).alias("start"),
        F.substring("data.end", 1, 10).alias("end"), F.col("parameters")["trend_method"].alias("trend_method"), F.col("parameters")["hv_max"].cast("double").alias("hv_max"),
        "results.trades", "results.wins", "results.total_pnl", "results.win_rate", "results.max_drawdown"))


# --- run store (2.8) ------------------------------------------------------------------
WIDE = P.RunParams(hv_min=10.0, hv_max=50.0, run_id="wide")
RUN_SETS = [(DEFAULT, 0), (WIDE, 1)]


def _dataset_of(spark, sf):
    d = catalog_datasets(spark, sf).filter(F.col("timeframe") == "1d").join(
        catalog_symbols(spark, sf).select("symbol_id", "symbol"), "symbol_id")
    return d.groupBy("symbol").agg(F.max_by("dataset_id", "end_date").alias("dataset_id"))


STORED_AT = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=order) for _, order in RUN_SETS]


def run_store(spark, sf):
    """Path of a store to which both parameter sets were appended, resolved in ONE grid job."""
    from .registry_core import grid_result

    def build():
        path = files.scratch(spark, "run-store")
        g = grid_result(spark, sf, tuple(p for p, _ in RUN_SETS))
        runs.save_runs(path, [(p, f"{p.run_id} filters", at) for (p, _), at in zip(RUN_SETS, STORED_AT)], g.trades, g.drawdown,
                       daily_bars(spark, sf), _dataset_of(spark, sf))
        return path
    return memo(spark, ("runs", sf), build)


def _store_tables(spark, sf):
    return runs.stored_runs(spark, run_store(spark, sf)), catalog_datasets(spark, sf), catalog_symbols(spark, sf)


def _run_ctes(p, order, sfx):
    body = O.suffix_ctes(O.signal_ctes(p) + "," + O.position_ctes(p), sfx)
    cfg = runs.config_json(p).replace("'", "''")
    return body + f""",
runs{sfx} AS (SELECT '{p.run_id}:' || r.symbol AS run_id, '{p.run_id} filters' AS run_name, ds.dataset_id,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {order} SECOND AS created_at, '{cfg}' AS config,
    strftime(r.t0, '%Y-%m-%d') AS start_date, strftime(r.t1, '%Y-%m-%d') AS end_date,
    coalesce(t.n, 0) AS total_trades, coalesce(t.wr, 0.0) AS win_rate, coalesce(t.tp, 0.0) AS total_pnl,
    coalesce(t.ap, 0.0) AS avg_pnl, CAST(NULL AS DOUBLE) AS sharpe_ratio, coalesce(d.md, 0.0) AS max_drawdown, CAST(NULL AS DOUBLE) AS runtime_seconds
  FROM (SELECT symbol, min(ts) AS t0, max(ts) AS t1 FROM ib GROUP BY symbol) r
  LEFT JOIN (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE pnl > 0) / count(*) AS wr, sum(pnl) AS tp,
             avg(pnl) AS ap FROM trades{sfx} GROUP BY symbol) t USING (symbol)
  LEFT JOIN (SELECT symbol, max(drawdown) AS md FROM dd2{sfx} GROUP BY symbol) d USING (symbol)
  LEFT JOIN dsof ds USING (symbol)),
st{sfx} AS (SELECT trade_no AS trade_id, '{p.run_id}:' || symbol AS run_id, entry_date, expiry_date AS exit_date,
    CAST(date_diff('day', CAST(entry_date AS DATE), CAST(expiry_date AS DATE)) AS BIGINT) AS days_held, pnl,
    CAST(NULL AS DOUBLE) AS pnl_pct, 'closed' AS status, 'eligible' AS entry_reason, outcome AS exit_reason,
    short_call - short_put AS strike_width, CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS iv_rank
  FROM trades{sfx})"""


RUNS_WITH = ("WITH RECURSIVE " + O.indicator_ctes(DAILY, P.BB_BASE_WINDOW, "VWAP Slope")
             + f""", symbols AS ({SYMBOLS_SQL}), datasets AS ({DATASETS_SQL}),
dsof AS (SELECT symbol, arg_max(dataset_id, end_date) AS dataset_id FROM datasets JOIN symbols USING (symbol_id)
         WHERE timeframe = '1d' GROUP BY symbol),"""
             + ",".join(_run_ctes(p, o, f"_{i}") for i, (p, o) in enumerate(RUN_SETS))
             + ", allruns AS (" + " UNION ALL ".join(f"SELECT * FROM runs_{i}" for i in range(len(RUN_SETS)))
             + "), alltrades AS (" + " UNION ALL ".join(f"SELECT * FROM st_{i}" for i in range(len(RUN_SETS)))
             + "), cataloged AS (SELECT r.*, d.file_path, s.symbol, d.timeframe FROM allruns r JOIN datasets d USING (dataset_id) "
               "JOIN symbols s USING (symbol_id))")
RUN_COLS = ["run_id", "run_name", "dataset_id", "config", "start_date", "end_date", "total_trades", "win_rate", "avg_pnl",
            "total_pnl", "sharpe_ratio", "max_drawdown", "runtime_seconds", "created_at"]
_RUN_D = {"win_rate", "total_pnl", "avg_pnl", "sharpe_ratio", "max_drawdown", "runtime_seconds"}


def _runsel(cols, src="allruns"):
    return ", ".join(f"{r6(c)} AS {c}" if c in _RUN_D else c for c in cols) + f" FROM {src}"


register("save_run", RUNS_WITH + " SELECT " + _runsel(RUN_COLS))(
    lambda spark, sf: finalize(_store_tables(spark, sf)[0].select(*RUN_COLS)))

ST_COLS = ["trade_id", "run_id", "entry_date", "exit_date", "days_held", "pnl", "pnl_pct", "status", "entry_reason",
           "exit_reason", "strike_width", "distance", "iv_rank"]
register("append_trades", RUNS_WITH + " SELECT " + ", ".join(
    f"{r6(c)} AS {c}" if c in {"pnl", "pnl_pct", "strike_width", "distance", "iv_rank"} else c for c in ST_COLS)
    + " FROM alltrades")(lambda spark, sf: finalize(runs.stored_trades(spark, run_store(spark, sf)).select(*ST_COLS)))

ONE_RUN = f"{WIDE.run_id}:1-URGENT"


@register("load_run", RUNS_WITH + f""" SELECT c.run_id, c.run_name, c.symbol, c.timeframe, c.file_path, c.total_trades,
  json_extract_string(c.config, '$.hv_min') AS hv_min, json_extract_string(c.config, '$.bb_window') AS bb_window,
  t.trade_id, t.entry_date, t.exit_date, t.exit_reason, {r6('t.pnl')} AS pnl
  FROM cataloged c JOIN alltrades t USING (run_id) WHERE c.run_id = '{ONE_RUN}'""")
def q_load_run(spark, sf):
    """One run by id with its parsed parameters and ordered trades."""
    _, datasets, symbols = _store_tables(spark, sf)
    run, trades = runs.load_run(spark, run_store(spark, sf), ONE_RUN, datasets, symbols)
    head = run.select("run_id", "run_name", "symbol", "timeframe", "file_path", "total_trades",
                      F.col("config")["hv_min"].alias("hv_min"), F.col("config")["bb_window"].alias("bb_window"))
    return finalize(head.join(trades.select("run_id", "trade_id", "entry_date", "exit_date", "exit_reason", "pnl"), "run_id"))


COMPARED = [f"{p.run_id}:{s}" for p, _ in RUN_SETS for s in ("1-URGENT", "3-MEDIUM")]
_PCT = "round(win_rate * 100, 2) AS win_rate_pct"
register("compare_runs", RUNS_WITH + f""" SELECT run_id, run_name, symbol, timeframe, start_date, end_date, total_trades, {_PCT},
  round(avg_pnl, 2) AS avg_pnl, round(total_pnl, 2) AS total_pnl, round(sharpe_ratio, 3) AS sharpe_ratio,
  round(max_drawdown * 100, 2) AS max_drawdown_pct, round(runtime_seconds, 2) AS runtime_sec, created_at
  FROM cataloged WHERE run_id IN ({", ".join(f"'{r}'" for r in COMPARED)})""")(
    lambda spark, sf: finalize(runs.compare_runs(_store_tables(spark, sf)[0], COMPARED, *_store_tables(spark, sf)[1:])))

register("list_runs", RUNS_WITH + f""" SELECT run_id, run_name, symbol, timeframe, start_date, end_date, total_trades, {_PCT},
  round(total_pnl, 2) AS total_pnl, round(sharpe_ratio, 3) AS sharpe, created_at FROM cataloged
  WHERE symbol <> '' ORDER BY created_at DESC, run_id DESC LIMIT 6""")(
    lambda spark, sf: finalize(runs.list_runs(*_store_tables(spark, sf), limit=6)))
register("list_runs_symbol", RUNS_WITH + f""" SELECT run_id, run_name, symbol, timeframe, start_date, end_date, total_trades, {_PCT},
  round(total_pnl, 2) AS total_pnl, round(sharpe_ratio, 3) AS sharpe, created_at FROM cataloged WHERE symbol = '2-HIGH'""")(
    lambda spark, sf: finalize(runs.list_runs(*_store_tables(spark, sf), symbol="2-HIGH")))
register("run_history", RUNS_WITH + " SELECT " + _runsel([*RUN_COLS, "file_path", "symbol", "timeframe"], "cataloged")
         + " ORDER BY created_at DESC, run_id DESC LIMIT 8")(
    lambda spark, sf: finalize(runs.run_history(*_store_tables(spark, sf), limit=8)))


@register("export_stored_run_json", RUNS_WITH + " SELECT " + _runsel(["run_id", "run_name", "dataset_id", "start_date", "end_date",
          "total_trades", "win_rate", "avg_pnl", "total_pnl", "max_drawdown"]) + " WHERE run_id = '" + ONE_RUN + "'")
def q_export_stored_run(spark, sf):
    """A stored run as a JSON document with its trades as JSON lines beside it, parsed back."""
    _, datasets, symbols = _store_tables(spark, sf)
    run, trades = runs.load_run(spark, run_store(spark, sf), ONE_RUN, datasets, symbols)
    path = files.scratch(spark, "stored-run-json")
    runs.export_json(run, trades, path)
    back = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.RUNS if f.name != "config")).json(f"{path}/run")
    sums = spark.read.schema("run_id string, pnl double").json(f"{path}/trades").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("s"))
    same = (F.col("n") == F.col("total_trades")) & (F.abs(F.col("s") - F.col("total_pnl")) < 1e-6)
    return finalize(back.join(sums, "run_id").where(same).select(
        "run_id", "run_name", "dataset_id", "start_date", "end_date", "total_trades", "win_rate", "avg_pnl", "total_pnl", "max_drawdown"))


@register("export_stored_trades_csv", RUNS_WITH + f""" SELECT trade_id, run_id, strftime(entry_date, '%Y-%m-%dT%H:%M:%S') AS entry_date,
  days_held, {r6('pnl')} AS pnl, exit_reason FROM alltrades""")
def q_export_stored_trades(spark, sf):
    t = runs.stored_trades(spark, run_store(spark, sf)).withColumn("entry_date", F.date_format("entry_date", "yyyy-MM-dd'T'HH:mm:ss"))
    back = _roundtrip(spark, t, "stored-trades-csv")
    return finalize(back.select(F.col("trade_id").cast("long").alias("trade_id"), "run_id", "entry_date",
                                F.col("days_held").cast("long").alias("days_held"), F.col("pnl").cast("double").alias("pnl"), "exit_reason"))


# --- presentation-side metric views (2.7) -------------------------------------------
_W = "outcome = 'win'"
_L = "outcome = 'loss'"


@register("legacy_stats", O.daily_backtest_with(DEFAULT) + f""" SELECT symbol,
  {r6('max((least(short_put - long_put, long_call - short_call) - net_credit) * 100.0 + ' + dbl(4 * P.PER_LEG_FEE) + ')')}
    AS max_risk, {r6('max(pnl)')} AS high_pl, {r6('min(pnl)')} AS low_pl,
  {r6(f'coalesce(max(pnl) FILTER (WHERE {_W}), 0.0)')} AS best_win,
  {r6(f'coalesce(min(pnl) FILTER (WHERE {_L}), 0.0)')} AS worst_loss,
  count(*) FILTER (WHERE {_W} OR {_L}) AS expired,
  {r6(f'CASE WHEN coalesce(sum(least(pnl, 0.0)) FILTER (WHERE {_L}), 0.0) < 0 THEN coalesce(sum(greatest(pnl, 0.0)) FILTER (WHERE {_W}), 0.0) / abs(sum(least(pnl, 0.0)) FILTER (WHERE {_L})) END')}
    AS profit_factor_legacy,
  {r6(f'CASE WHEN count(*) FILTER (WHERE {_W}) > 0 AND count(*) FILTER (WHERE {_L}) > 0 AND abs(avg(pnl) FILTER (WHERE {_L})) > 0 THEN avg(pnl) FILTER (WHERE {_W}) / abs(avg(pnl) FILTER (WHERE {_L})) END')}
    AS reward_risk_legacy
  FROM trades GROUP BY symbol""")
def q_legacy(spark, sf):
    return finalize(metrics.legacy_stats(result(spark, sf).trades))


@register("trades_per_day", O.daily_backtest_with(DEFAULT) + f""" SELECT e.symbol, coalesce(t.n, 0) AS trades,
  date_diff('day', min(e.ts), max(e.ts)) AS date_range_days,
  {r6('CASE WHEN date_diff(\'day\', min(e.ts), max(e.ts)) > 0 THEN coalesce(t.n, 0) / (date_diff(\'day\', min(e.ts), max(e.ts)) / 252.0) / 252.0 ELSE 0.0 END')}
    AS trades_per_day
  FROM equity e LEFT JOIN (SELECT symbol, count(*) AS n FROM trades GROUP BY symbol) t USING (symbol)
  GROUP BY e.symbol, t.n""")
def q_trades_per_day(spark, sf):
    return finalize(metrics.trades_per_day(result(spark, sf).trades, result(spark, sf).equity))


@register("trades_display", O.daily_backtest_with(DEFAULT) + f""" SELECT symbol,
  strftime(entry_date, '%Y-%m-%d %H:%M') AS entry_date, strftime(expiry_date, '%Y-%m-%d %H:%M') AS expiry_date,
  {", ".join(f"printf('%.2f', {c}) AS {c}" for c in TRADE_FMT)}, outcome FROM trades
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_no DESC) <= {P.MAX_TABLE_ROWS}""")
def q_trades_display(spark, sf):
    return finalize(metrics.trades_display(result(spark, sf).trades, TRADE_FMT))


@register("rejected_display", O.daily_backtest_with(DEFAULT) + f""" SELECT symbol,
  strftime(ts, '%Y-%m-%d %H:%M') AS date, CASE WHEN {_REASONS} = '' THEN 'Not eligible' ELSE {_REASONS} END AS reasons,
  printf('%.2f', adx) AS adx, printf('%.2f', rsi) AS rsi, printf('%.2f', hv) AS hv FROM sig WHERE NOT eligible
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= {P.MAX_TABLE_ROWS}""")
def q_rejected_display(spark, sf):
    return finalize(metrics.rejected_display(result(spark, sf).rejected))


@register("trade_markers", O.daily_backtest_with(DEFAULT) + f""" SELECT t.symbol, t.entry_date,
  {r6('b.vwap')} AS entry_vwap, t.expiry_date, {r6('t.expiry_close')} AS exit_close, t.outcome
  FROM trades t JOIN res b ON b.symbol = t.symbol AND b.ts = t.entry_date""")
def q_markers(spark, sf):
    r = result(spark, sf)
    return finalize(metrics.trade_markers(r.trades, r.bars))


@register("trend_markers", O.daily_backtest_with(DEFAULT) + f""" SELECT symbol, ts, {r6('vwap')} AS vwap,
  trend_up, trend_down FROM res WHERE trend_up OR trend_down""")
def q_trend_markers(spark, sf):
    return finalize(result(spark, sf).bars.filter(F.col("trend_up") | F.col("trend_down"))
                    .select("symbol", "ts", "vwap", "trend_up", "trend_down"))


@register("blackout_spans", O.daily_backtest_with(DEFAULT) + f""", ev AS ({O.blackout_values()}),
  sp AS (SELECT event_date, CAST(event_date - INTERVAL {DEFAULT.days_before} DAY AS DATE) AS span_start,
         CAST(event_date + INTERVAL {DEFAULT.days_after} DAY AS DATE) AS span_end FROM ev)
  SELECT r.symbol, strftime(sp.event_date, '%Y-%m-%d') AS event_date, strftime(sp.span_start, '%Y-%m-%d') AS span_start,
    strftime(sp.span_end, '%Y-%m-%d') AS span_end, count(*) AS bars_in_span
  FROM res r JOIN sp ON CAST(r.ts AS DATE) BETWEEN sp.span_start AND sp.span_end
  GROUP BY r.symbol, sp.event_date, sp.span_start, sp.span_end""")
def q_spans(spark, sf):
    from .operators.signals import blackout_spans
    from .sources.fixtures import blackout_dates
    return finalize(blackout_spans(result(spark, sf).bars, blackout_dates(spark), DEFAULT.days_before,
                                   DEFAULT.days_after))


@register("ingest_upload", INGEST_SQL.replace("SELECT symbol, 'equity'", "SELECT upper(symbol) AS symbol, 'equity'").replace("'csv_import'", "'streamlit_upload'")
          .replace("'symbol=' || symbol", "'symbol=' || upper(symbol)"))
def q_ingest_upload(spark, sf):
    """Upload path: symbol upper-cased, vendor recorded as the upload source."""
    return ingest_query(spark, daily_bars(spark, sf).withColumn("symbol", F.upper("symbol")), vendor="streamlit_upload")
