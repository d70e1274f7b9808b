"""Indicators that go on from a stored state when bars are appended.

A batch reads its new bars and, for each key, one state row of the batch before: the
next row index, the last bars that the windows look back on, and for every
exponential average its value and last valid position (an affine map needs no more of
the past). It writes its indicator rows and the next state beside them. Nothing older is
read. A batch is named by its number; writing one again replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..plans import ordered
from ..session import cut_lineage
from .indicators import AVERAGES, RAW_COLUMNS, averages, indicator_lookback, windows

BAR = ["ts", "open", "high", "low", "close", "vwap", "volume"]
_EWM = {o: src for part in AVERAGES for o, src in part.items()}


def append(spark: SparkSession, path: str, bars: DataFrame, batch: int, keys: Sequence[str] = ("symbol",), bb_window: int = P.BB_BASE_WINDOW,
           bar_seconds: int = P.SMALLEST_BAR_SECONDS, seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    """Write and return the indicators (before fills) of ``bars``, which follow all bars of batch ``batch - 1``.

    Every bar must be later than the key's bars before (ValueError); keys may come and go.
    All batches are written with the same ``bb_window``."""
    keys = list(keys)
    back = indicator_lookback(bb_window)
    new = cut_lineage(bars.select(*keys, *BAR))
    rows = ordered.with_row_index(new, keys, ["ts"], "ts", bar_seconds).withColumn("_new", F.lit(True))
    prev = before = None
    if batch > 0:
        prev = spark.read.parquet(f"{path}/state/batch={batch - 1}")
        old = prev.select(*keys, "next_idx", "last_ts")
        if new.join(old, keys).where("ts <= last_ts").take(1):
            raise ValueError(f"batch {batch} holds bars that are not later than those stored before")
        rows = rows.join(old, keys, "left").withColumn("idx", F.col("idx") + F.coalesce("next_idx", F.lit(0))).drop("next_idx", "last_ts")
        tail = prev.select(*keys, F.explode("tail").alias("t")).select(*keys, "t.*", F.lit(False).alias("_new"))
        rows = rows.unionByName(tail.join(new.select(*keys).distinct(), keys, "left_semi"))
        before = prev.select(*keys, *[F.col(f"{kind}{o}") for o in _EWM for kind in ("_y_", "_l_")])
    h = ordered.halo(rows, back=back, seg_rows=seg_rows)
    h = cut_lineage(ordered.home(windows(h, keys, bb_window)).where("_new"))
    h = cut_lineage(averages(h, keys, before))
    h.select(*keys, *BAR, "idx", *RAW_COLUMNS).write.mode("overwrite").parquet(f"{path}/indicators/batch={batch}")

    valid = lambda src: F.when(F.col(src).isNotNull(), F.col("idx"))
    ends = h.groupBy(*keys).agg(F.max("idx").alias("_last"), F.max("ts").alias("last_ts"), *[e for o, src in _EWM.items() for e in (
        F.max_by(o, "idx").alias(f"_y_{o}"), F.max(valid(src)).alias(f"_l_{o}"))])
    kept = rows.join(ends.select(*keys, "_last"), keys).where(F.col("idx") > F.col("_last") - back)
    tails = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", *BAR))).alias("tail"))
    state = ends.withColumn("next_idx", F.col("_last") + 1).drop("_last").join(tails, keys)
    if prev is not None:
        # a position before the batch stays the last valid one where the batch has none; keys without new bars keep their state
        past = prev.select(*keys, *[F.col(f"_l_{o}").alias(f"_p_{o}") for o in _EWM])
        state = state.join(past, keys, "left")
        state = state.withColumns({f"_l_{o}": F.coalesce(f"_l_{o}", f"_p_{o}") for o in _EWM}).drop(*[f"_p_{o}" for o in _EWM])
        state = state.unionByName(prev.join(ends.select(*keys), keys, "left_anti"))
    state.write.mode("overwrite").parquet(f"{path}/state/batch={batch}")
    return spark.read.parquet(f"{path}/indicators/batch={batch}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of all batches."""
    return spark.read.parquet(f"{path}/indicators").drop("batch")
