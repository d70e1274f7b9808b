"""File sources and sinks: CSV bars, blackout-date text, Parquet bar store,
file fingerprints, directory ingest.

Scratch output goes under the session's shared checkpoint folder, never a
machine-local temp folder. Schemas are explicit (CSV is read as text and cast
with ``try_cast``), never inferred.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import number, parse_ts
from ..session import checkpoint_dir

#: First lines of files that are read at a time.
HEADERS_AT_ONCE = 16

BAR_FIELDS = ["open", "high", "low", "close", "vwap", "volume"]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def csv_headers(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, str]]:
    """(file, first line) of each CSV file that is not empty.

    The files are listed by Spark without being read; one line of each is then read through
    Hadoop's file system, several at a time, so a file's rows are read once only, later."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = [r.path for r in spark.read.format("binaryFile").load(paths).where("length > 0").select("path").collect()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(name: str) -> tuple[str, str]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            raw = stream if codec is None else codec.createInputStream(stream)
            return name, jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(raw, "UTF-8")).readLine() or ""
        finally:
            stream.close()

    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        return list(pool.map(first_line, listed))


def _column_names(header: str) -> list[str]:
    return [c.strip().strip('"').strip().lower() for c in next(csv.reader([header.lstrip("\ufeff")]))]


def csv_groups(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[list[str], list[str]]]:
    """(column names, files) for each distinct header; a listing, so it is small."""
    groups: dict[str, list[str]] = {}
    for file, header in csv_headers(spark, paths):
        groups.setdefault(header, []).append(file)
    return [(_column_names(h), sorted(f)) for h, f in sorted(groups.items())]


def _typed(raw: DataFrame) -> DataFrame:
    kinds = {"timestamp": lambda c: parse_ts(c), **{c: lambda x: number(F.col(x)) for c in BAR_FIELDS}}
    return raw.select(*[(kinds[c](c).alias(c) if c in kinds else F.col(c)) for c in raw.columns])


def _read_group(spark: SparkSession, names: list[str], files: list[str]) -> DataFrame:
    """Files that share a header, every column as text; repeated or empty names get their position."""
    unique = [n if n and names.index(n) == k else f"{n or 'column'}_{k}" for k, n in enumerate(names)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in unique])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(files)


def scan_csv_bars(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with header -> typed bars. Header names are lower-cased and trimmed, and
    columns go by name in every file, whatever their order; text that does not
    parse and NaN become NULL. Files without a column get NULL there."""
    out = None
    for names, files in csv_groups(spark, path):
        part = _typed(_read_group(spark, names, files))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no CSV file under {path}")
    return out.select(*columns) if columns else out


# Date formats accepted in a blackout-dates text file besides timestamps.
BLACKOUT_FORMATS = ["d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyyMMdd"]


def scan_blackout_dates(spark: SparkSession, path: str) -> DataFrame:
    """One date per line; blank lines and '#' comments skipped; lines that do
    not parse are dropped silently; duplicates kept; day precision."""
    lines = spark.read.text(path).select(F.trim(F.translate("value", "\ufeff", "")).alias("v"))
    lines = lines.filter((F.col("v") != "") & ~F.col("v").startswith("#"))
    d = F.coalesce(parse_ts("v"), *[F.try_to_timestamp(F.col("v"), F.lit(f)).cast("timestamp_ntz") for f in BLACKOUT_FORMATS])
    return lines.select(F.to_date(d).alias("event_date")).filter(F.col("event_date").isNotNull())


def sink_parquet_bars(bars: DataFrame, path: str, timeframe_col: str = "timeframe", keep_others: bool = False) -> str:
    """Partitioned by (symbol, timeframe), sorted by time inside files, zstd,
    dictionary encoding and statistics (so later range filters prune files
    and row groups). A range repartition on (symbol, timeframe, ts) gives each
    writer a contiguous time slice, so one huge symbol is written by many
    tasks. The whole store is replaced, with ``keep_others`` only the
    (symbol, timeframe) folders that ``bars`` has rows for."""
    (bars.repartitionByRange("symbol", timeframe_col, "ts")
         .sortWithinPartitions("symbol", timeframe_col, "ts")
         .write.mode("overwrite").partitionBy("symbol", timeframe_col)
         .option("partitionOverwriteMode", "dynamic" if keep_others else "static")
         .option("compression", "zstd").parquet(path))
    return path


STORE_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    *[T.StructField(c, T.DoubleType()) for c in BAR_FIELDS],
    T.StructField("symbol", T.StringType()),
    T.StructField("timeframe", T.StringType()),
])


#: Stored bars with the range of days of their data set.
DATED_SCHEMA = T.StructType([*STORE_SCHEMA.fields, T.StructField("dates", T.StringType())])


def scan_parquet_bars(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.schema(STORE_SCHEMA).parquet(path)
    return df.select(*(columns or STORE_SCHEMA.fieldNames()))     # further partition columns are left out


def file_fingerprint(spark: SparkSession, path_glob: str) -> DataFrame:
    """SHA-256 of each file's bytes (and the 16-hex cache key); files of up to 2 GB."""
    b = spark.read.format("binaryFile").load(path_glob)
    h = F.sha2(F.col("content"), 256)
    return b.select(F.col("path"), F.col("length"), h.alias("sha256"), F.substring(h, 1, 16).alias("cache_key"))


def ingest_directory(spark: SparkSession, root: str, pattern: str = "*",
                     required: Sequence[str] = ("timestamp", "open", "high", "low", "close", "volume")) -> tuple:
    """All CSV files ``root/{pattern}.csv`` and all CSV parts of folders ``root/{pattern}``.

    The symbol is the file's (or folder's, ``<col>=<stem>`` included) stem up to
    the first '_'. Files are read by their own header; a file that lacks a required
    column, headers included, is in the report with what is missing, so each
    file is either in the bars or in the rejects. Returns (bars, report)."""
    found = []
    for glob in (f"{root}/{pattern}.csv", f"{root}/{pattern}/*.csv"):
        try:
            found += csv_groups(spark, glob)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not found:
        raise ValueError(f"no CSV file under {root}")
    bars = counts = None
    listing = []
    place = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "")
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(place, "/"), -1), "^[^=]*=", ""), r"\.csv$", "")
    symbol = F.split(stem, "_").getItem(0)
    for names, files in found:
        raw = _read_group(spark, names, files)
        missing = [c for c in required if c not in names]
        listing += [(f, f"missing: {', '.join(missing)}" if missing else "ok") for f in files]
        part = raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        counts = part if counts is None else counts.unionByName(part)
        if not missing:
            own = _typed(raw.select(*[F.col(f"`{c}`") for c in raw.columns], symbol.alias("_symbol")))
            own = own.select(F.col("_symbol").alias("symbol"), F.col("timestamp").alias("ts"),
                             *[(F.col(c) if c in names else F.lit(None).cast("double")).alias(c) for c in BAR_FIELDS])
            bars = own if bars is None else bars.unionByName(own)
    if bars is None:
        bars = spark.createDataFrame([], "symbol string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in BAR_FIELDS))
    files = spark.createDataFrame(listing, "file string, status string").join(counts, "file", "left")
    named = files.select("status", "n", F.struct(F.col("file").alias("file_path")).alias("_metadata"))
    report = named.select(place.alias("place"), symbol.alias("symbol"), "status", "n").groupBy("place", "symbol", "status").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return bars, report.select("symbol", "rows", "status")


def segment_table(bars: DataFrame, name: str, path: str, back: int, keys: Sequence[str] = ("symbol",), bar_seconds: int | None = None,
                  seg_rows: int | None = None, buckets: int = 16) -> DataFrame:
    """Bars stored the way window plans want them: row index, segments and their halo of ``back`` rows,
    bucketed and sorted by (keys, segment, index).

    Windows of up to ``back`` rows per (keys, segment) read the table ``name`` without an exchange
    (``plans.ordered.home`` keeps each segment's own rows)."""
    from .. import params as P
    from ..operators.indicators import indexed_bars
    from ..plans import ordered

    rows = ordered.halo(indexed_bars(bars, keys, bar_seconds or P.SMALLEST_BAR_SECONDS), back=back, seg_rows=seg_rows or ordered.SEG_ROWS)
    by = [*keys, ordered.SEG]
    (rows.repartition(buckets, *by).sortWithinPartitions(*by, "idx").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *by).sortBy(*by, "idx").saveAsTable(name))
    return bars.sparkSession.table(name)
