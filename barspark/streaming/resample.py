"""Bars from a stream, with a watermark and a side table of late rows.

Ticks arrive as files. A stateful aggregation keeps the open buckets in Spark's state
store (in the checkpoint folder, which is shared) and appends a bar once the watermark,
the greatest time of the batches before less the allowed delay, has passed its end. A
row comes too late for its bar when the watermark of the batch before its own had passed the
bucket's end, so that the bar is out; Spark drops it there. A second pass over the same files
with the same watermark lists these rows.
Both passes go on from their checkpoints after a stop, and both write a batch again
under its own number, so a killed run that is started anew gives the same tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.resample import order_key

#: Files of one micro-batch, if the caller does not say: the batches, and with them the watermark, are the same in both passes.
FILES = 1


def _stream(spark: SparkSession, source: str, schema: T.StructType, files: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)


def append_arrival(ticks: DataFrame, source: str, files: int) -> None:
    """Append ``ticks`` under ``source`` as exactly ``files`` files, the batch of one arrival.

    No task holds more than its file; files that have no rows are written too, so that the next arrival begins a new batch."""
    spark = ticks.sparkSession

    def put(rows: DataFrame) -> int:
        rows.write.mode("append").option("maxRecordsPerFile", 0).parquet(source)
        return len(spark.read.schema(ticks.schema).parquet(source).inputFiles())

    there = put(ticks.coalesce(files))
    while there % files:
        there = put(ticks.limit(0))


#: Batches without files would advance the watermark at the end of a call and make the result depend on where calls end.
_QUIET = "spark.sql.streaming.noDataMicroBatches.enabled"


def _run(frame: DataFrame, checkpoint: str, write) -> None:
    conf = frame.sparkSession.conf
    before = conf.get(_QUIET)
    conf.set(_QUIET, "false")
    try:
        q = frame.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(_QUIET, before)


def resample_stream(spark: SparkSession, source: str, schema: T.StructType, out: str, seconds: int, delay_seconds: int,
                    keys: Sequence[str] = ("symbol",), files: int = FILES) -> tuple[DataFrame, DataFrame]:
    """Take in the files that are new under ``source``; (bars of closed buckets, late rows) of all calls.

    Ticks have ``keys``, ts, seq and prices. Buckets that the watermark has not passed
    stay in the state until later files close them; rows without a time are ignored. A micro-batch
    takes ``files`` files, the same number in all calls (see ``append_arrival``)."""
    keys, width = list(keys), f"{int(seconds)} seconds"
    ticks = _stream(spark, source, schema, files).where("ts is not null")
    # a watermark needs an instant: the wall-clock time in the session's zone, which the engine pins to UTC
    timed = ticks.withColumn("_at", F.col("ts").cast("timestamp_ltz"))
    first = lambda c: F.struct(order_key("ts", "seq").alias("o"), F.col(c).alias("v"))
    bars = (timed.withWatermark("_at", f"{int(delay_seconds)} seconds").groupBy(F.window("_at", width).alias("w"), *keys)
            .agg(F.min(first("open")).alias("_o"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(first("close")).alias("_c"),
                 F.avg("vwap").alias("vwap"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"))
            .select(*keys, F.col("w.start").cast("timestamp_ntz").alias("ts"), F.col("_o.v").alias("open"), "high", "low", F.col("_c.v").alias("close"), "vwap", "volume"))

    def add_bars(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/bars/batch_id={n}")

    def add_late(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        kept = f"{out}/seen/batch_id={n}"
        # a batch leaves one row with its greatest time; the batch before had the watermark of all before itself
        batch.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(kept)
        top = spark.read.schema("top timestamp_ntz, batch_id bigint").parquet(f"{out}/seen").where(F.col("batch_id") < n - 1).agg(F.max("top")).first()[0]
        mark = F.lit(str(top)).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(delay_seconds)} SECOND")
        late = batch.where(F.window("ts", width).end <= mark) if top is not None else batch.limit(0)
        late.write.mode("overwrite").parquet(f"{out}/late/batch_id={n}")

    _run(bars, f"{out}/checkpoint/bars", add_bars)
    _run(ticks, f"{out}/checkpoint/late", add_late)
    return (spark.read.schema(bars.schema).parquet(f"{out}/bars").drop("batch_id"),
            spark.read.schema(ticks.schema).parquet(f"{out}/late").drop("batch_id"))
