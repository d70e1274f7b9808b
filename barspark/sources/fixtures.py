"""Bar-shaped inputs derived from the given tables.

The given tables hold no price bars, so ticks are derived from them by fixed
rules (F0-F5). Every rule is a projection or a grouped aggregate, so the work
grows with the tables; the same rules are written in the oracle SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import ts_lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one tick per order; symbol = order priority, price from the total."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    p = F.lit(100.0) + F.col("o_totalprice") / F.lit(100000.0)
    return o.select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), p.alias("vwap"),
        (F.lit(1) + F.col("o_orderkey") % 100).cast("double").alias("volume"),
    )


def ticks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one tick per event; symbol = event type, volume from ``props.k``."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "props")
    p = F.lit(100.0) + F.col("value") / F.lit(100.0)
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), p.alias("vwap"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def dirty_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F0 with deterministic damage and a text timestamp column.

    high/low are widened by 0.5 first; ``seq % 97 = 0`` -> high NULL,
    ``seq % 89 = 0`` -> high and low swapped, ``seq % 83 = 0`` -> 'bad' time.
    """
    t = ticks_orders(spark, sf_dir)
    s = F.col("seq")
    p = F.col("close")
    return t.select(
        "symbol",
        F.when(s % 83 == 0, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        "seq", "open",
        F.when(s % 97 == 0, F.lit(None).cast("double"))
         .when(s % 89 == 0, p - F.lit(0.5)).otherwise(p + F.lit(0.5)).alias("high"),
        F.when(s % 89 == 0, p + F.lit(0.5)).otherwise(p - F.lit(0.5)).alias("low"),
        "close", "vwap", "volume",
    )


# The F4 blackout (event) dates used by the derived fixtures.
BLACKOUT_DATES = ["1995-07-04", "1996-03-15", "1997-11-27", "1999-01-18", "2000-04-20", "2001-02-14"]


def blackout_dates(spark: SparkSession, dates: list[str] | None = None) -> DataFrame:
    """a tiny literal event-date table (always broadcast where used)."""
    rows = [(dt.date.fromisoformat(d),) for d in (BLACKOUT_DATES if dates is None else dates)]
    return spark.createDataFrame(rows, schemas.BLACKOUT)


CATALOG_CREATED = dt.datetime(2024, 1, 1, 0, 0, 0)


def catalog_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 symbols: order priorities, event types and region names (the last have no data)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct() \
        .withColumn("asset_type", F.lit("equity")).withColumn("vendor", F.lit("orders"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct() \
        .withColumn("asset_type", F.lit("crypto")).withColumn("vendor", F.lit("events"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("symbol")).distinct() \
        .withColumn("asset_type", F.lit("index")).withColumn("vendor", F.lit("region"))
    u = o.unionByName(e).unionByName(r)
    return u.select(
        symbol_id_expr("symbol").alias("symbol_id"),
        "symbol", "asset_type", "vendor",
        F.concat(F.lit("derived symbol "), F.col("symbol")).alias("description"),
        ts_lit(CATALOG_CREATED).alias("created_at"),
        ts_lit(CATALOG_CREATED).alias("updated_at"),
    )


def text_id(c: F.Column) -> F.Column:
    """Deterministic id of a text: the first 52 bits of its MD5 digest."""
    return F.conv(F.substring(F.md5(c), 1, 13), 16, 10).cast("long")


def symbol_id_expr(symbol: str) -> F.Column:
    return text_id(F.col(symbol))


def dataset_id_expr(symbol: str, timeframe: F.Column, part: F.Column) -> F.Column:
    return text_id(F.concat(F.col(symbol), F.lit("|"), timeframe, F.lit("|"), part.cast("string")))


def catalog_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 datasets: F0 grouped per (symbol, year) as '1d', F2 per (symbol, day-of-month
    decade) as '1min'. Dates are 'YYYY-MM-DD' text as in the original catalog."""
    t0 = ticks_orders(spark, sf_dir).withColumn("timeframe", F.lit("1d")) \
        .withColumn("part", F.year("ts"))
    t2 = ticks_events(spark, sf_dir).withColumn("timeframe", F.lit("1min")) \
        .withColumn("part", F.floor((F.dayofmonth("ts") - 1) / 10).cast("int"))
    t = t0.unionByName(t2)
    g = t.groupBy("symbol", "timeframe", "part").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("row_count"))
    start = F.date_format("t0", "yyyy-MM-dd")
    end = F.date_format("t1", "yyyy-MM-dd")
    safe = F.translate(F.translate(F.col("symbol"), "/", "_"), ":", "_")
    return g.select(
        dataset_id_expr("symbol", F.col("timeframe"), F.col("part")).alias("dataset_id"),
        symbol_id_expr("symbol").alias("symbol_id"),
        "timeframe",
        start.alias("start_date"), end.alias("end_date"),
        F.col("row_count").cast("long").alias("row_count"),
        F.concat(F.lit("bars/"), safe, F.lit("_"), F.col("timeframe"), F.lit("_"), start, F.lit("_"), end,
                 F.lit(".parquet")).alias("file_path"),
        (F.col("row_count") * F.lit(48) + F.lit(4096)).cast("long").alias("file_size_bytes"),
        ts_lit(CATALOG_CREATED).alias("created_at"),
    )
