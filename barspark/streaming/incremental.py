"""Incremental ingest with Structured Streaming.

New CSV files under a folder are picked up by the file source; the
checkpoint remembers which files were processed, ``availableNow`` drains what
is there and stops. The stream carries file names only; each batch reads its
files by their own headers. ``foreachBatch`` is at-least-once, so each batch writes
to its own ``batch_id`` folder with overwrite: a replayed batch replaces its
own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import BAR_FIELDS, scan_csv_bars

NAMES = "path string, modificationTime timestamp_ltz, length bigint, content binary"


def ingest_incremental(spark: SparkSession, source: str, table: str, checkpoint: str) -> DataFrame:
    """Ingest the files that are new since the last call with this checkpoint; the whole table."""
    new = spark.readStream.format("binaryFile").schema(NAMES).option("pathGlobFilter", "*.csv").load(source).where("length > 0").select("path")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]
        if not paths:
            return
        bars = scan_csv_bars(batch.sparkSession, paths).withColumnRenamed("timestamp", "ts")
        names = ["symbol", "ts", *BAR_FIELDS]
        kinds = dict(zip(names, ["string", "timestamp_ntz", *["double"] * len(BAR_FIELDS)]))
        cols = [F.col(c) if c in bars.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]
        bars.select(*cols).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    q = (new.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(table).drop("batch_id")
