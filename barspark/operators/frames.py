"""Aggregates over a RANGE of time: the last ``days`` days instead of the last n rows.

Rows with equal key and time are peers and share a frame, so they collapse to one row
of partial sums first. Those rows are cut into time segments as long as the span, each
with a halo of the span before it: a row is in two segments, a segment holds
at most two spans of distinct times, and a key is as many tasks as it has spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import epoch_seconds


def range_frames(rows: DataFrame, keys: Sequence[str], value: str, days: int, ts: str = "ts") -> DataFrame:
    """keys, ts, peers (rows at that time), and over the closed span [ts - days, ts]: n (values), sum, avg, min, max.

    One row a (key, time). Rows without a time have no frame; a frame without values has n 0
    and nulls. Times are compared by the microsecond."""
    keys = list(keys)
    v = F.col(value).cast("double")
    times = rows.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("ts")).agg(
        F.count(F.lit(1)).alias("peers"), F.count(v).alias("_n"), F.sum(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    span = int(days) * 86_400 * 1_000_000
    times = times.withColumn("_us", epoch_seconds("ts") * 1_000_000 + F.date_format("ts", "SSSSSS").cast("bigint"))
    own = F.floor(F.col("_us") / span)
    halo = times.withColumn("_seg", F.explode(F.array(own, own + 1))).withColumn("_home", F.col("_seg") == own)
    w = Window.partitionBy(*keys, "_seg").orderBy("_us").rangeBetween(-span, 0)
    out = halo.select(*keys, "ts", "peers", "_home", F.sum("_n").over(w).alias("n"), F.sum("_s").over(w).alias("sum"),
                      F.min("_lo").over(w).alias("min"), F.max("_hi").over(w).alias("max")).where("_home")
    return out.select(*keys, "ts", "peers", "n", "sum", F.try_divide("sum", "n").alias("avg"), "min", "max")
