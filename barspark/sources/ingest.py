"""Ingest that commits: bars to Parquet, then symbol and dataset rows to the catalog.

A data set is the folder of one symbol, timeframe and range of days,
``symbol=S/timeframe=T/dates=START_END``. A batch with another range is another data
set; one with a known range replaces that folder, and its catalog row gets the new
facts. Only the folders of the batch are read back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..session import ts_lit
from . import files
from .fixtures import text_id

PARTS = ["symbol", "timeframe", "dates"]
#: Data sets of a batch that are named in the filter on their folders; with more, they are joined.
NAMED = 1000
#: Bounds a written file far below 2 GB, so that it can be digested in one piece.
FILE_ROWS = 10_000_000


def _local(path):
    """Local paths without their scheme; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def _folder(path):
    return _local(F.regexp_replace(path, "/[^/]*$", ""))


def stored_folders(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file_path, file_size_bytes, checksum of the data set folders under a root, or of given files.

    The checksum is the SHA-256 of the sorted digests of the folder's files; each
    file is digested on its own."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths)
             .select("path", "length", F.sha2("content", 256).alias("digest")))
    return found.groupBy(_folder("path").alias("file_path")).agg(
        F.sum("length").alias("file_size_bytes"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("digest"))), 256).alias("checksum"))


def _store(bars: DataFrame, timeframe: str, root: str) -> DataFrame:
    """Write a batch; the data sets (``PARTS``) that it holds."""
    kinds = {f.name: f.dataType for f in files.STORE_SCHEMA}
    cols = [F.col(c) if c in bars.columns else F.lit(None).cast(kinds[c]).alias(c) for c in files.BAR_FIELDS]
    batch = bars.select("symbol", F.lit(timeframe).alias("timeframe"), "ts", *cols)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    sets = batch.groupBy("symbol", "timeframe").agg(F.concat_ws("_", day(F.min("ts")), day(F.max("ts"))).alias("dates"))
    (batch.join(sets, ["symbol", "timeframe"]).repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
     .option("compression", "zstd").partitionBy(*PARTS).parquet(root))
    return sets


def _only(store: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of the given data sets, by a filter on the partition columns."""
    named = sets.limit(NAMED + 1).collect()
    if len(named) > NAMED:
        return store.join(sets, PARTS, "left_semi")
    keep = F.lit(False)
    for r in named:
        keep = keep | ((F.col("symbol") == F.lit(r.symbol)) & (F.col("timeframe") == F.lit(r.timeframe)) & (F.col("dates") == F.lit(r.dates)))
    return store.where(keep)


def ingest_frame(spark: SparkSession, bars: DataFrame, timeframe: str, root: str, catalog_path: str, asset_type: str = "equity",
                 vendor: str = "csv_import", write: bool = True, at: dt.datetime | None = None, description: str | None = None) -> None:
    """Store bars (symbol, ts, prices) under ``root`` and commit one dataset row a symbol.

    Other data sets under ``root`` stay as they are and are not read. Only ``ts`` (and the symbol) are required; other bar
    columns may be missing. ``write=False`` registers everything that is there already."""
    if "ts" not in bars.columns:
        raise ValueError("Missing required columns: ['timestamp']")
    at = ts_lit(at or dt.datetime.now().replace(microsecond=0))
    if write and bars.isEmpty():
        return
    sets = _store(bars, timeframe, root) if write else None
    store = spark.read.schema(files.DATED_SCHEMA).parquet(root)
    store = store if sets is None else _only(store, sets)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    # this column, unlike a path, is URL-encoded
    path = F.url_decode(F.regexp_replace("_metadata.file_path", "[+]", "%2B"))
    parts = store.groupBy(path.alias("file"), "symbol", "timeframe").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count(F.lit(1)).alias("n")).collect()
    if not parts:
        return
    # one row a file of this batch
    profile = spark.createDataFrame(parts, "file string, symbol string, timeframe string, t0 timestamp_ntz, t1 timestamp_ntz, n bigint")
    profile = profile.groupBy(_folder("file").alias("file_path"), "symbol", "timeframe").agg(
        day(F.min("t0")).alias("start_date"), day(F.max("t1")).alias("end_date"), F.sum("n").alias("row_count"))
    data = profile.join(stored_folders(spark, sorted(r.file for r in parts)), "file_path").select(
        text_id(F.concat_ws("|", "symbol", "timeframe", "file_path")).alias("dataset_id"), text_id(F.col("symbol")).alias("symbol_id"), "symbol",
        "timeframe", "start_date", "end_date", "row_count", "file_path", "file_size_bytes", "checksum", at.alias("created_at"))
    symbols = data.select("symbol_id", "symbol", F.lit(asset_type).alias("asset_type"), F.lit(vendor).alias("vendor"),
                          F.lit(description).cast("string").alias("description"), at.alias("created_at"), at.alias("updated_at")).distinct()
    catalog.commit(spark, catalog_path, symbols, data)
