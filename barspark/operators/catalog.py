"""Dataset catalog as small tables: symbols and datasets (one row per stored
file). Snapshots are rewritten by joins (merge = full outer join with
latest-wins columns, delete = anti join); the catalog row is the commit marker
of an ingest, written after the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_datasets(datasets: DataFrame, symbols: DataFrame, symbol: str | None = None,
                  timeframe: str | None = None) -> DataFrame:
    j = datasets.join(symbols.select("symbol_id", "symbol", "asset_type"), "symbol_id")
    if symbol is not None:
        j = j.filter(F.col("symbol") == symbol)
    if timeframe is not None:
        j = j.filter(F.col("timeframe") == timeframe)
    return j.orderBy("symbol", "timeframe", "start_date")


def mb(bytes_col) -> F.Column:
    """Bytes -> MiB rounded to 2 places."""
    return F.round(bytes_col.cast("double") / F.lit(1024.0) / F.lit(1024.0), 2)


def list_symbols(symbols: DataFrame, datasets: DataFrame) -> DataFrame:
    j = symbols.join(datasets.drop("created_at"), "symbol_id", "left")
    return (j.groupBy("symbol", "asset_type", "vendor")
             .agg(F.count_distinct("dataset_id").alias("dataset_count"),
                  F.count_distinct("timeframe").alias("timeframe_count"),
                  F.min("start_date").alias("earliest_date"), F.max("end_date").alias("latest_date"),
                  F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
                  mb(F.coalesce(F.sum("file_size_bytes"), F.lit(0))).alias("total_size_mb"))
             .orderBy("symbol"))


def timeframes_for_symbol(symbols: DataFrame, datasets: DataFrame) -> DataFrame:
    return datasets.join(symbols.select("symbol_id", "symbol"), "symbol_id").select("symbol", "timeframe").distinct()


def overlapping(datasets: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Datasets whose [start_date, end_date] meets [start, end] (text dates)."""
    d = datasets
    if start:
        d = d.filter(~(F.col("end_date") < F.lit(start)))
    if end:
        d = d.filter(~(F.col("start_date") > F.lit(end)))
    return d


def date_range_summary(symbols: DataFrame, datasets: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Whole-dataset numbers of the overlapping datasets per symbol/timeframe."""
    d = overlapping(datasets, start, end).join(symbols.select("symbol_id", "symbol"), "symbol_id")
    return (d.groupBy("symbol", "timeframe")
             .agg(F.sum("row_count").alias("total_rows"), F.count(F.lit(1)).alias("dataset_count"),
                  F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"),
                  mb(F.sum("file_size_bytes")).alias("total_size_mb")))


def orphans(symbols: DataFrame, datasets: DataFrame, runs: DataFrame | None = None, trades: DataFrame | None = None) -> DataFrame:
    """Integrity audit the declared foreign keys would have enforced; with the
    run store's tables also runs without dataset and trades without run (ids are
    text there, so ``id`` is NULL and ``name`` holds the run id)."""
    no_sym = (datasets.join(symbols, "symbol_id", "left_anti")
                      .select(F.lit("dataset_without_symbol").alias("kind"), F.col("dataset_id").alias("id"),
                              F.col("file_path").alias("name")))
    no_data = (symbols.join(datasets, "symbol_id", "left_anti")
                      .select(F.lit("symbol_without_dataset").alias("kind"), F.col("symbol_id").alias("id"),
                              F.col("symbol").alias("name")))
    out = no_sym.unionByName(no_data)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("id"), F.col("run_id").alias("name")).distinct()
    if runs is not None:
        out = out.unionByName(named(runs.join(datasets, "dataset_id", "left_anti"), "run_without_dataset"))
        if trades is not None:
            out = out.unionByName(named(trades.join(runs, "run_id", "left_anti"), "trade_without_run"))
    return out


def upsert_symbols(symbols: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert new symbols; for known ones replace asset_type/vendor/description
    and updated_at, also by NULL. The id and created_at of a known symbol stay."""
    o, n = symbols.alias("o"), updates.alias("n")
    j = o.join(n, F.col("o.symbol") == F.col("n.symbol"), "full")
    given = F.col("n.symbol").isNotNull()
    pick = lambda c: F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return j.select(F.coalesce(F.col("o.symbol_id"), F.col("n.symbol_id")).alias("symbol_id"),
                    F.coalesce(F.col("o.symbol"), F.col("n.symbol")).alias("symbol"),
                    pick("asset_type"), pick("vendor"), pick("description"),
                    F.coalesce(F.col("o.created_at"), F.col("n.created_at")).alias("created_at"),
                    pick("updated_at"))


def register_datasets(datasets: DataFrame, new: DataFrame) -> DataFrame:
    """Add datasets whose file_path is not registered yet; a known path keeps its id and creation
    time and takes the new facts (dates, rows, size, checksum), as its file was replaced. A path given
    twice in one batch is registered once, with the smallest dataset_id."""
    rest = [c for c in datasets.columns if c != "file_path"]
    once = new.groupBy("file_path").agg(F.min_by(F.struct(*rest), F.col("dataset_id")).alias("_r")).select("file_path", "_r.*")
    o, n = datasets.alias("o"), once.alias("n")
    j = o.join(n, F.col("o.file_path") == F.col("n.file_path"), "full")
    given = F.col("n.file_path").isNotNull()
    pick = lambda c: F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*[(pick(c) if c in FACTS else F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c in datasets.columns])


#: Columns that describe a dataset's file as it is now.
FACTS = ("start_date", "end_date", "row_count", "file_size_bytes", "checksum")


SYMBOLS = ("symbol_id bigint, symbol string, asset_type string, vendor string, description string, created_at timestamp_ntz, "
           "updated_at timestamp_ntz")
DATASETS = ("dataset_id bigint, symbol_id bigint, timeframe string, start_date string, end_date string, row_count bigint, "
            "file_path string, file_size_bytes bigint, checksum string, created_at timestamp_ntz")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete snapshots: the datasets of a version are written last."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()
                  and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/datasets/_SUCCESS")))


def snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored catalog table as of the newest complete commit; empty before the first."""
    schema = {"symbols": SYMBOLS, "datasets": DATASETS}[name]
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v={versions[-1]}/{name}")


def commit(spark: SparkSession, path: str, symbols: DataFrame, datasets: DataFrame) -> None:
    """Upsert symbols and register datasets in one new version folder ``v=<n>``.

    Its datasets are written last and make both tables visible together; what a failed commit left
    behind is overwritten by the next. One writer at a time."""
    versions = _versions(spark, path)
    at = f"{path}/v={versions[-1] + 1 if versions else 1}"
    for name, merge, new in (("symbols", upsert_symbols, symbols), ("datasets", register_datasets, datasets)):
        old = snapshot(spark, path, name)
        merge(old, new.select(*old.columns)).select(*old.columns).coalesce(1).write.mode("overwrite").parquet(f"{at}/{name}")


def delete_datasets(datasets: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove catalog rows by id; the data files stay where they are."""
    return datasets.join(ids.select("dataset_id"), "dataset_id", "left_anti")
