"""Run store: one row per (parameter set, symbol) run plus its trades, on Parquet.

``save_runs`` appends any number of resolved parameter sets in one pass: the
parameters are a literal table, metrics are one aggregate by (run_id, symbol), trades
are written partitioned by parameter set. Readers join the stored tables with the
catalog. Units: ``win_rate`` is the share of trades with pnl > 0 as a fraction and
``max_drawdown`` is in currency in the store; readers present percent.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P

RUNS = T.StructType([T.StructField(n, t) for n, t in (
    ("run_id", T.StringType()), ("run_name", T.StringType()), ("dataset_id", T.LongType()), ("config", T.StringType()),
    ("start_date", T.StringType()), ("end_date", T.StringType()), ("total_trades", T.LongType()), ("win_rate", T.DoubleType()),
    ("avg_pnl", T.DoubleType()), ("total_pnl", T.DoubleType()), ("sharpe_ratio", T.DoubleType()), ("max_drawdown", T.DoubleType()),
    ("runtime_seconds", T.DoubleType()), ("created_at", T.TimestampNTZType()))])
TRADES = T.StructType([T.StructField(n, t) for n, t in (
    ("trade_id", T.LongType()), ("entry_date", T.TimestampNTZType()), ("exit_date", T.TimestampNTZType()), ("days_held", T.LongType()),
    ("pnl", T.DoubleType()), ("pnl_pct", T.DoubleType()), ("status", T.StringType()), ("entry_reason", T.StringType()),
    ("exit_reason", T.StringType()), ("strike_width", T.DoubleType()), ("distance", T.DoubleType()), ("iv_rank", T.DoubleType()),
    ("run_id", T.StringType()))])


def config_json(p: P.RunParams) -> str:
    d = p.as_dict()
    d.pop("run_id", None)
    return json.dumps(d, sort_keys=True)


def stored_id(run: str | Column, symbol: str | Column) -> Column:
    return F.concat_ws(":", run, symbol)


def save_runs(path: str, runs: Sequence[tuple[P.RunParams, str | None, dt.datetime]], trades: DataFrame, drawdown: DataFrame,
              bars: DataFrame, dataset_of: DataFrame, runtime_seconds: float | None = None) -> None:
    """Store runs and their trades under ``path``; sets that are there under the same id are replaced.

    ``runs``: (parameters, name, creation time); ``trades`` and ``drawdown`` carry
    ``run_id`` and ``symbol``; ``dataset_of``: (symbol, dataset_id)."""
    spark = bars.sparkSession
    given = spark.createDataFrame([(p.run_id, name, config_json(p), at) for p, name, at in runs],
                                  "run_id string, run_name string, config string, created_at timestamp_ntz")
    per = ["run_id", "symbol"]
    n = F.count(F.lit(1))
    t = trades.groupBy(*per).agg(n.alias("total_trades"), (F.count_if(F.col("pnl") > 0) / n).alias("win_rate"),
                                 F.avg("pnl").alias("avg_pnl"), F.sum("pnl").alias("total_pnl"))
    dd = drawdown.groupBy(*per).agg(F.max("drawdown").alias("max_drawdown"))
    ids = F.explode(F.array(*[F.lit(p.run_id) for p, _, _ in runs])).alias("run_id")
    span = bars.groupBy("symbol").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("start_date"),
                                      F.date_format(F.max("ts"), "yyyy-MM-dd").alias("end_date"))
    rows = (span.select("*", ids).join(F.broadcast(given), "run_id").join(t, per, "left").join(dd, per, "left")
            .join(dataset_of, "symbol", "left").select(
                stored_id("run_id", "symbol").alias("run_id"), "run_name", "dataset_id", "config", "start_date", "end_date",
                F.coalesce("total_trades", F.lit(0)).cast("long").alias("total_trades"), F.coalesce("win_rate", F.lit(0.0)).alias("win_rate"),
                F.coalesce("avg_pnl", F.lit(0.0)).alias("avg_pnl"), F.coalesce("total_pnl", F.lit(0.0)).alias("total_pnl"),
                F.lit(None).cast("double").alias("sharpe_ratio"), F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"),
                F.lit(runtime_seconds).cast("double").alias("runtime_seconds"), "created_at"))
    stored = trades.select(
        F.col("trade_no").cast("long").alias("trade_id"), "entry_date", F.col("expiry_date").alias("exit_date"),
        F.datediff(F.to_date("expiry_date"), F.to_date("entry_date")).cast("long").alias("days_held"),
        "pnl", F.lit(None).cast("double").alias("pnl_pct"), F.lit("closed").alias("status"), F.lit("eligible").alias("entry_reason"),
        F.col("outcome").alias("exit_reason"), (F.col("short_call") - F.col("short_put")).alias("strike_width"),
        F.lit(None).cast("double").alias("distance"), F.lit(None).cast("double").alias("iv_rank"), stored_id("run_id", "symbol").alias("run_id"))
    # the trades first: a run row commits its trades. A parameter set is one folder, whatever the number of its
    # symbols, and each folder is written by few tasks; saving a set again replaces it
    for table, name in ((stored, "trades"), (rows, "runs")):
        set_id = F.split("run_id", ":")[0]
        (table.withColumn("set_id", set_id).repartition("set_id", F.pmod(F.xxhash64("run_id"), F.lit(WRITERS))).sortWithinPartitions("set_id", "run_id")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_id").parquet(f"{path}/{name}"))


#: Tasks that write one parameter set.
WRITERS = 8


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(f"{path}/runs").select(*RUNS.fieldNames())


def stored_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades of the runs that are committed."""
    trades = spark.read.schema(TRADES).parquet(f"{path}/trades").select(*TRADES.fieldNames())
    return trades.join(stored_runs(spark, path).select("run_id"), "run_id", "left_semi")


def with_catalog(runs: DataFrame, datasets: DataFrame, symbols: DataFrame) -> DataFrame:
    """Runs with file_path, timeframe and symbol of their dataset (runs without one drop out)."""
    return (runs.join(datasets.select("dataset_id", "symbol_id", "timeframe", "file_path"), "dataset_id")
                .join(symbols.select("symbol_id", "symbol"), "symbol_id").drop("symbol_id"))


def load_run(spark: SparkSession, path: str, run_id: str, datasets: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run with parsed ``config`` map, its trades by entry date); ValueError when the id is unknown."""
    run = with_catalog(stored_runs(spark, path).where(F.col("run_id") == run_id), datasets, symbols)
    if run.isEmpty():
        raise ValueError(f"Backtest run_id={run_id} not found")
    trades = stored_trades(spark, path).where(F.col("run_id") == run_id).orderBy("entry_date", "trade_id")
    return run.withColumn("config", F.from_json("config", "map<string,string>")), trades


def export_json(run: DataFrame, trades: DataFrame, path: str) -> None:
    """``path``/run holds the run as one JSON document, ``path``/trades its trades as JSON lines."""
    run.write.mode("overwrite").json(f"{path}/run")
    trades.write.mode("overwrite").json(f"{path}/trades")


def _newest(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc())


def compare_runs(runs: DataFrame, run_ids: Sequence[str], datasets: DataFrame, symbols: DataFrame) -> DataFrame:
    """The given runs side by side, newest first."""
    r = with_catalog(runs.where(F.col("run_id").isin(list(run_ids))), datasets, symbols)
    return _newest(r).select(
        "run_id", "run_name", "symbol", "timeframe", "start_date", "end_date", "total_trades",
        F.round(F.col("win_rate") * 100, 2).alias("win_rate_pct"), F.round("avg_pnl", 2).alias("avg_pnl"), F.round("total_pnl", 2).alias("total_pnl"),
        F.round("sharpe_ratio", 3).alias("sharpe_ratio"), F.round(F.col("max_drawdown") * 100, 2).alias("max_drawdown_pct"),
        F.round("runtime_seconds", 2).alias("runtime_sec"), "created_at")


def list_runs(runs: DataFrame, datasets: DataFrame, symbols: DataFrame, limit: int = 20, symbol: str | None = None) -> DataFrame:
    """The newest runs (of one symbol) with summary metrics."""
    r = with_catalog(runs, datasets, symbols)
    r = r if symbol is None else r.where(F.col("symbol") == symbol)
    return _newest(r).limit(limit).select(
        "run_id", "run_name", "symbol", "timeframe", "start_date", "end_date", "total_trades",
        F.round(F.col("win_rate") * 100, 2).alias("win_rate_pct"), F.round("total_pnl", 2).alias("total_pnl"),
        F.round("sharpe_ratio", 3).alias("sharpe"), "created_at")


def run_history(runs: DataFrame, datasets: DataFrame, symbols: DataFrame, dataset_id: int | None = None, limit: int = 50) -> DataFrame:
    """All run columns with file_path, symbol and timeframe, newest first (of one dataset)."""
    r = runs if dataset_id is None else runs.where(F.col("dataset_id") == dataset_id)
    return _newest(with_catalog(r, datasets, symbols)).limit(limit)
