"""Sessions: runs of a key's events with no pause of ``gap`` or more.

A key is cut into time buckets that are worked on apart. Inside a bucket boundary flags
and their running sum give its runs; a run that neither begins nor ends a bucket's
series is a session already. Only the first and last run of each (key, bucket) can go
on in a neighbour, so at most two rows a bucket, whatever the number of events, meet
again to be chained.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import UNB, epoch_seconds
from .asof import bucket_seconds


def _micros(ts: str) -> F.Column:
    """Microseconds of the wall-clock time since 1970."""
    return epoch_seconds(ts) * 1_000_000 + F.date_format(F.col(ts), "SSSSSS").cast("bigint")


def sessions(events: DataFrame, keys: Sequence[str], gap_seconds: float, ts: str = "ts", sums: Sequence[str] = (), seconds: int | None = None) -> DataFrame:
    """keys, session_start, session_end (times of the first and last event), n_events and the sum of each column of ``sums``.

    A pause of exactly the gap parts two sessions. Events without a time belong to none;
    a null key is a key; sums of nulls only are null."""
    keys, gap = list(keys), int(round(gap_seconds * 1_000_000))
    rows = events.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_ts"), *dict.fromkeys(sums))
    seconds = seconds or bucket_seconds(rows, keys, "_ts")
    rows = rows.withColumn("_us", _micros("_ts")).withColumn("_b", F.floor(F.col("_us") / (seconds * 1_000_000)))
    w = Window.partitionBy(*keys, "_b").orderBy("_us")
    pause = F.col("_us") - F.lag("_us").over(w)
    rows = rows.withColumn("_new", F.when(pause < gap, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(UNB, 0)))
    add = [F.sum(c).alias(c) for c in sums]
    parts = [F.min("_ts").alias("session_start"), F.max("_ts").alias("session_end"), F.min("_us").alias("_from"), F.max("_us").alias("_to")]
    runs = rows.groupBy(*keys, "_b", "_run").agg(*parts, F.count(F.lit(1)).alias("n_events"), *add)
    last = F.max("_run").over(Window.partitionBy(*keys, "_b"))
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == last))
    cols = [*keys, "session_start", "session_end", "n_events", *sums]
    chain = Window.partitionBy(*keys).orderBy("_from", "_to")
    edges = runs.where("_edge")
    # inside a bucket two runs never join; over the border they do if the pause is short
    joined = (F.col("_run") == 1) & (F.col("_from") - F.lag("_to").over(chain) < gap)
    edges = edges.withColumn("_new", F.when(joined, 0).otherwise(1))
    edges = edges.withColumn("_s", F.sum("_new").over(chain.rowsBetween(UNB, 0)))
    merged = edges.groupBy(*keys, "_s").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n_events").alias("n_events"), *add)
    return runs.where("not _edge").select(*cols).unionByName(merged.select(*cols))
