"""Spark session defaults for the engine.

Timestamps are TIMESTAMP_NTZ end to end, the session zone is pinned to UTC so
the few epoch conversions are stable, ANSI mode stays on (divisions go through
``try_divide``), AQE re-plans joins and coalesces partitions at run time.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Window stages are CPU-bound: do not let AQE merge small shuffles into a
    # single task (its 1 MB floor does that at bench scale); large data still
    # coalesces towards the 64 MB advisory size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    # Window groups are bounded (segment of 65,536 rows plus halo); beyond this
    # many rows Spark's spillable buffer takes over.
    "spark.sql.windowExec.buffer.in.memory.threshold": str(1 << 14),
    # lineage cuts are deleted when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def ts_lit(value) -> "Column":
    """A TIMESTAMP_NTZ literal from a naive datetime or 'YYYY-MM-DD HH:MM:SS'
    text, independent of the session time zone and default timestamp type."""
    from pyspark.sql import functions as F

    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")


# Runtime SQL settings the engine's semantics rely on; applied to whatever
# session a query is given (the driver may pass its own).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
    "spark.sql.windowExec.buffer.in.memory.threshold": str(1 << 14),
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_spark(master: str | None = None, app: str = "barspark",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Taken from ``spark.checkpoint.dir`` as the cluster names it. Only a local
    session (tests, benches) gets a private folder when it is unset; on a
    cluster an unset value is an error, never a machine-local temp folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    d = tempfile.mkdtemp(prefix="barspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss); never localCheckpoint.

    The frame is cached only while the checkpoint is written, so the plan
    runs once (the write would otherwise recompute it); afterwards readers
    use the checkpoint files, whose partitioning Spark still knows.
    """
    from pyspark import StorageLevel

    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()
