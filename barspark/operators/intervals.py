"""Interval-overlap join with bins of many widths.

An interval lives at the level whose bins (2**level days) are just longer than
itself, so it touches two bins there at most, whether it spans a day or ten years. Two
intervals meet at the higher of their two levels: the longer one at its own level, the
shorter one as a visitor of that level's bins. Intervals that are both only visitors
of a bin are never paired. A pair that shares two bins is given by the first of them. Bins
are equi-join keys, so crowded ones are split like any skewed key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _days(c: F.Column) -> F.Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows (all columns of both) with equal ``keys`` whose closed spans of dates or times share a day.

    Spans are given by day. A span with a null end, or one that ends before it begins, overlaps
    nothing. Columns of ``b`` that are keys or also in ``a`` come from ``a``."""
    keys = list(keys)

    def placed(df: DataFrame, span: tuple[str, str], p: str) -> DataFrame:
        at, to = (_days(F.to_date(F.col(c))) for c in span)
        out = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(p), at.alias(f"{p}0"), to.alias(f"{p}1"))
        out = out.where(f"{p}0 <= {p}1")
        # least level whose bins are as long as the span
        return out.withColumn(f"{p}l", F.ceil(F.log2(F.col(f"{p}1") - F.col(f"{p}0") + 1)).cast("int"))

    x, y = placed(a, a_span, "_x"), placed(b, b_span, "_y")
    levels = sorted({r[0] for df, c in ((x, "_xl"), (y, "_yl")) for r in df.select(c).distinct().collect()})   # at most some twenty

    def bins(df: DataFrame, p: str, own: bool) -> DataFrame:
        """Rows by (level, bin): of their own level, or of all higher levels."""
        level = F.col(f"{p}l")
        at = F.array(level) if own else F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda l: l > level)
        rows = df.withColumn("_level", F.explode(at))
        width = F.pow(F.lit(2), F.col("_level"))
        return rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}0") / width), F.floor(F.col(f"{p}1") / width))))

    on = [*(f"_k{i}" for i in range(len(keys))), "_level", "_bin"]

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        width = F.pow(F.lit(2), F.col("_level"))
        first = F.floor(F.greatest("_x0", "_y0") / width) == F.col("_bin")
        return left.join(right, on).where((F.col("_x0") <= F.col("_y1")) & (F.col("_y0") <= F.col("_x1")) & first).select("_x", "_y")

    xs, ys = bins(x, "_x", True), bins(y, "_y", True)
    pairs = met(xs, ys).unionByName(met(xs, bins(y, "_y", False))).unionByName(met(bins(x, "_x", False), ys))
    return pairs.select("_x.*", *[F.col(f"_y.{c}").alias(c) for c in b.columns if c not in a.columns])
