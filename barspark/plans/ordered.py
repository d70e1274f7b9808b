"""Ordered-series plans that never put a whole key into one task.

Every bar operator is "per key (symbol, run), in time order". The naive Spark
form is ``Window.partitionBy(key).orderBy(ts)``: one task per key, so a key
holding a third of all rows becomes one task holding a third of all rows.
This module splits each key into bounded pieces instead:

* ``with_row_index`` numbers rows per key in parallel: counts per
  (key, time bucket) -> exclusive prefix over the small bucket table ->
  local ``row_number`` inside each bucket. A bucket spans ``rows_per_bucket``
  bar widths, so it holds at most that many distinct bars.
* ``halo`` cuts the index into segments of ``seg_rows`` rows and copies the
  ``back`` rows before and ``fwd`` rows after each segment into it. Every
  bounded-lookback/lookahead window then runs per (key, segment) and is exact
  on the segment's own ("home") rows. Partitions hold at most
  ``seg_rows + back + fwd`` rows whatever the skew.
* ``running`` and ``fill_both`` handle the unbounded operations (running sums
  and maxima, back/forward fills) in two levels: a local pass per segment and a
  carry from a per-segment summary table (one row per segment), joined back on
  (key, segment). The big side keeps its partitioning; only the summary moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG_ROWS = 1 << 16          # rows per segment at scale
ROWS_PER_BUCKET = 1 << 16   # bar widths per time bucket for the row index
SEG = "_seg"
HOME = "_home"
UNB = Window.unboundedPreceding


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970-01-01 00:00 of the wall-clock time (no time zone is
    involved, so bucketing is the same in every session)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def with_row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   ts: str = "ts", bar_seconds: int = 60, out: str = "idx",
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """0-based position of each row inside its key, ordered by ``order``.

    ``bar_seconds`` is the smallest spacing of distinct timestamps (the bar
    width); it bounds the rows of one time bucket by ``rows_per_bucket``.
    Row numbers are taken per (key, bucket) first; the bucket sizes come from
    that same window output, so the input is shuffled once and both branches
    reuse the exchange; the offsets table has one row per bucket.
    """
    keys = list(keys)
    width = int(bar_seconds) * int(rows_per_bucket)
    b = df.withColumn("_tb", F.floor(epoch_seconds(ts) / F.lit(width)))
    wl = Window.partitionBy(*keys, "_tb").orderBy(*order)
    local = b.withColumn("_rn", F.row_number().over(wl))
    counts = local.groupBy(*keys, "_tb").agg(F.max("_rn").alias("_n"))
    wk = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(UNB, -1)
    offsets = counts.select(*keys, "_tb", F.coalesce(F.sum("_n").over(wk), F.lit(0)).alias("_off"))
    j = local.join(offsets, on=[*keys, "_tb"], how="inner")
    return j.withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long")).drop("_tb", "_off", "_rn")


def halo(df: DataFrame, idx: str = "idx", back: int = 0, fwd: int = 0,
         seg_rows: int = SEG_ROWS) -> DataFrame:
    """Assign segments and replicate boundary rows (``HOME`` marks the original)."""
    i = F.col(idx)
    s = F.lit(int(seg_rows))
    lo = F.floor(F.greatest(i - F.lit(int(fwd)), F.lit(0)) / s)
    hi = F.floor((i + F.lit(int(back))) / s)
    return (df.withColumn(SEG, F.explode(F.sequence(lo, hi)))
              .withColumn(HOME, F.col(SEG) == F.floor(i / s)))


def segment(df: DataFrame, idx: str = "idx", seg_rows: int = SEG_ROWS) -> DataFrame:
    """Segment column without replication (for purely two-level operations)."""
    return df.withColumn(SEG, F.floor(F.col(idx) / F.lit(int(seg_rows))))


def seg_window(keys: Sequence[str], idx: str = "idx", seg: str = SEG):
    return Window.partitionBy(*keys, seg).orderBy(idx)


def home(df: DataFrame) -> DataFrame:
    return df.filter(F.col(HOME)).drop(HOME)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
            values: dict[str, str], op: str = "sum", seg: str = SEG) -> DataFrame:
    """Running ``sum`` or ``max`` of ``values`` (out name -> source column).

    Rows are ordered by ``seg`` then ``order``; ``seg`` must be a
    non-decreasing function of the order (a segment of the row index).
    """
    keys = list(keys)
    agg = F.sum if op == "sum" else F.max
    wl = Window.partitionBy(*keys, seg).orderBy(*order).rowsBetween(UNB, 0)
    local = df
    for out, src in values.items():
        local = local.withColumn(f"_loc_{out}", agg(src).over(wl))
    summ = df.groupBy(*keys, seg).agg(*[agg(src).alias(f"_tot_{out}") for out, src in values.items()])
    wp = Window.partitionBy(*keys).orderBy(seg).rowsBetween(UNB, -1)
    summ = summ.select(*keys, seg, *[agg(f"_tot_{out}").over(wp).alias(f"_off_{out}") for out in values])
    j = local.join(summ, on=[*keys, seg], how="left")
    for out in values:
        loc, off = F.col(f"_loc_{out}"), F.col(f"_off_{out}")
        if op == "sum":
            val = F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0))
        else:
            val = F.greatest(loc, off)
        j = j.withColumn(out, val).drop(f"_loc_{out}", f"_off_{out}")
    return j


def fill_both(df: DataFrame, keys: Sequence[str], cols: Sequence[str], idx: str = "idx",
              seg: str = SEG) -> DataFrame:
    """Back-fill then forward-fill each column along ``idx`` within a key.

    Equals ``coalesce(x, next non-null, previous non-null)``. Back-fill uses
    the descending order with a growing frame (a linear scan), never an
    ``unboundedFollowing`` frame. ``df`` is read twice (local pass and segment
    summary); persist it when it is expensive.
    """
    keys = list(keys)
    up = Window.partitionBy(*keys, seg).orderBy(F.col(idx).desc()).rowsBetween(UNB, 0)
    dn = Window.partitionBy(*keys, seg).orderBy(idx).rowsBetween(UNB, 0)
    out = df.select("*", *[F.last(c, ignorenulls=True).over(up).alias(f"_nx_{c}") for c in cols])
    out = out.select("*", *[F.last(c, ignorenulls=True).over(dn).alias(f"_pv_{c}") for c in cols])
    aggs = []
    for c in cols:
        keyed = F.when(F.col(c).isNotNull(), F.col(idx))
        aggs += [F.min_by(c, keyed).alias(f"_f_{c}"), F.max_by(c, keyed).alias(f"_l_{c}")]
    summ = df.groupBy(*keys, seg).agg(*aggs)
    w_after = Window.partitionBy(*keys).orderBy(F.col(seg).desc()).rowsBetween(UNB, -1)
    w_before = Window.partitionBy(*keys).orderBy(seg).rowsBetween(UNB, -1)
    summ = summ.select(*keys, seg, *[f"_l_{c}" for c in cols],
                       *[F.last(f"_f_{c}", ignorenulls=True).over(w_after).alias(f"_na_{c}") for c in cols])
    summ = summ.select("*", *[F.last(f"_l_{c}", ignorenulls=True).over(w_before).alias(f"_pb_{c}")
                              for c in cols]).drop(*[f"_l_{c}" for c in cols])
    j = out.join(summ, on=[*keys, seg], how="left")
    rest = [c for c in df.columns if c not in cols]
    return j.select(*rest, *[F.coalesce(c, f"_nx_{c}", f"_na_{c}", f"_pv_{c}", f"_pb_{c}").alias(c)
                             for c in cols])


def rolling(x: str | Column, w: Window, n: int, fn: str) -> Column:
    """Framed aggregate over the last ``n`` rows of a segment window."""
    c = F.col(x) if isinstance(x, str) else x
    frame = w.rowsBetween(-(int(n) - 1), 0)
    return {"avg": F.avg, "std": F.stddev_pop, "count": F.count, "sum": F.sum,
            "max": F.max, "min": F.min}[fn](c).over(frame)


def rolling_mean_std(x: str | Column, keys: Sequence[str], n: int, framed_to: int = 400, idx: str = "idx", seg: str = SEG):
    """(mean, population std, non-null count) over the last ``n`` rows of a segment.

    Windows of up to ``framed_to`` rows are frames. A frame costs O(rows * n) in
    Spark, so a longer window is put together of two runs that cost O(rows): rows
    are cut into blocks of ``n``; the window is the run from its block's start to
    the row, and the run from the window's first row to the end of the block
    before. Each run keeps count, mean and squared deviations (Spark's central
    moments), and the two are merged by the pairwise formula, so nothing is taken
    as a difference of large sums. The runs keep the least and largest value too: a
    flat window is its value, with exactly no deviation.
    """
    c, n = (F.col(x) if isinstance(x, str) else x).cast("double"), int(n)
    w = seg_window(keys, idx, seg)
    if n <= framed_to:
        return rolling(c, w, n, "avg"), rolling(c, w, n, "std"), rolling(c, w, n, "count")
    block = Window.partitionBy(*keys, seg, F.floor(F.col(idx) / F.lit(n)))
    head = block.orderBy(idx).rowsBetween(UNB, 0)
    tail = block.orderBy(F.col(idx).desc()).rowsBetween(UNB, 0)
    whole = F.col(idx) % n == n - 1          # the last row of a block: its run is the window
    none = F.lit(0)

    def part(fn, frame):
        return fn(c).over(frame)

    def before(value):
        return F.when(~whole, F.lag(value, n - 1).over(w))

    n1, n2 = part(F.count, head), F.coalesce(before(part(F.count, tail)), none)
    m1, m2 = F.coalesce(part(F.avg, head), none), F.coalesce(before(part(F.avg, tail)), none)
    s1, s2 = F.coalesce(part(F.var_pop, head), none) * n1, F.coalesce(before(part(F.var_pop, tail) * part(F.count, tail)), none)
    count, gap = n1 + n2, m2 - m1
    mean = F.when(n1 == 0, F.when(n2 > 0, m2)).otherwise(m1 + F.when(n2 > 0, gap * n2 / F.nullif(count, none)).otherwise(0.0))
    between = F.when((n1 > 0) & (n2 > 0), gap * gap * (n1 * n2) / F.nullif(count, none)).otherwise(0.0)
    low = F.least(part(F.min, head), before(part(F.min, tail)))
    flat = low == F.greatest(part(F.max, head), before(part(F.max, tail)))
    std = F.sqrt((s1 + s2 + between) / F.nullif(count, none))
    return F.when(flat, low).otherwise(mean), F.when(flat, 0.0).otherwise(std), count
