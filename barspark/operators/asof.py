"""As-of join: each left row with the last right row at or before it, per key.

Both sides become one series, ordered by time with the right side first among equal
times; a left row takes the last right row before it in that order. The series is cut
into time buckets, so a key is many tasks: inside a bucket a running ``last`` that
skips left rows, and for rows without one there the carry, the last right row of any
bucket before (one summary row a bucket, joined back on key and bucket). No range
join, no expansion of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import SEG_ROWS, UNB, epoch_seconds

HOUR = 3600


def bucket_seconds(rows: DataFrame, keys: Sequence[str], ts: str, at_most: int = SEG_ROWS, start: int = 24 * HOUR) -> int:
    """A bucket width of at most ``start`` seconds for about ``at_most`` rows a (key, bucket).

    One aggregate counts the rows by hour. Whole hours are put together while the fullest
    run stays small; an hour that is too full is divided evenly."""
    hours = rows.where(F.col(ts).isNotNull()).groupBy(*keys, F.floor(epoch_seconds(ts) / HOUR).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    wide = hours.groupBy(*keys, F.floor(F.col("_h") * HOUR / start)).agg(F.sum("_n").alias("_d"), F.max("_n").alias("_n"))
    full, hour = wide.agg(F.max("_d"), F.max("_n")).first()
    if (full or 0) <= at_most:
        return start
    return HOUR if hour <= at_most else max(1, HOUR * at_most // hour)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], left_ts: str = "ts", right_ts: str = "ts",
              seconds: int | None = None, exact: bool = True, prefix: str = "") -> DataFrame:
    """All rows of ``left`` with ``columns`` of the last right row whose time is not after theirs (before it, if not ``exact``).

    Rows without a match, without a time or with a null key get nulls. Right rows with a
    null key or time match nothing; of right rows with equal key and time the one with the
    greatest ``columns`` counts. New columns are named ``prefix`` + name."""
    keys = list(keys)
    known = lambda ts: F.col(ts).isNotNull()
    r = right.where(known(right_ts))
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    value = F.struct(F.col(right_ts).alias("_at"), *[F.col(c) for c in columns])
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    lk, rk = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], [f"_k{i}" for i in range(len(keys))]
    seconds = seconds or bucket_seconds(left.select(*lk, left_ts), rk, left_ts)
    # among equal times the right side comes first, or last if equal times are no match
    sides = (0, 1) if exact else (1, 0)
    both = (r.select(*lk, F.col(right_ts).alias("_t"), F.lit(sides[0]).alias("_side"), value.alias("_v"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_row"))
            .unionByName(left.select(*lk, F.col(left_ts).alias("_t"), F.lit(sides[1]).alias("_side"), F.lit(None).cast(r.select(value.alias("v")).schema["v"].dataType).alias("_v"), row.alias("_row"))))
    both = both.withColumn("_b", F.floor(epoch_seconds("_t") / seconds))
    inside = Window.partitionBy(*rk, "_b").orderBy("_t", "_side", "_v")
    local = both.withColumn("_own", F.last("_v", ignorenulls=True).over(inside.rowsBetween(UNB, 0)))
    # one row a bucket: its last right row, then the last one of all buckets before
    right_rows = both.where("_v is not null").select(*rk, "_b", "_v").groupBy(*rk, "_b").agg(F.max("_v").alias("_v"))
    asked = both.where("_row is not null").select(*rk, "_b").distinct().withColumn("_v", F.lit(None).cast(right_rows.schema["_v"].dataType))
    buckets = right_rows.unionByName(asked).groupBy(*rk, "_b").agg(F.max("_v").alias("_v"))
    earlier = Window.partitionBy(*rk).orderBy("_b").rowsBetween(UNB, -1)
    carry = buckets.select(*[F.col(k).alias(f"c{k}") for k in rk], F.col("_b").alias("c_b"), F.last("_v", ignorenulls=True).over(earlier).alias("_carry"))
    carry = carry.where("_carry is not null")
    same = F.col("_b") == F.col("c_b")
    for k in rk:
        same = same & (F.col(k) == F.col(f"c{k}"))
    out = local.where("_row is not null").join(carry, same, "left").select("_row", F.when(F.col("_t").isNotNull(), F.coalesce("_own", "_carry")).alias("_m"))
    return out.select("_row.*", F.col("_m._at").alias(f"{prefix}{right_ts}_matched"), *[F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in columns])
