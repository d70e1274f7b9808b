"""Exact quantiles without one buffer a key, and mergeable sketches.

Exact: rows collapse to counts by (key, value); the counts are dealt over ranges of
(key, value), so a key that holds all rows is spread like any other; a running count
inside a range and the totals of the ranges before it give every value its ranks, and
the two ranks around a quantile pick their values. Sketches: one KLL and one
HyperLogLog state a group is an ordinary column; states are stored and merged later
without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import UNB
from ..session import cut_lineage


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.5,), ranges: int | None = None) -> DataFrame:
    """keys and one column ``q<k>`` a quantile: linear interpolation between the two nearest ranks, nulls ignored.

    Keys without a value are absent. Equals SQL's ``quantile_cont``."""
    keys = list(keys)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cols = [*keys, "_v"]
    dealt = counts.repartitionByRange(ranges, *cols) if ranges else counts.repartitionByRange(*cols)
    # ranges are drawn by sampling: the number of a row's range is fixed by writing it down
    dealt = cut_lineage(dealt.withColumn("_r", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_r").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(UNB, -1)
    totals = totals.select(*keys, "_r", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"),
                           F.sum("_t").over(Window.partitionBy(*keys)).alias("_all"))
    inside = Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(UNB, 0)
    ranked = dealt.withColumn("_c", F.sum("_n").over(inside))
    same = ranked["_r"] == totals["_r"]
    for k in keys:
        same = same & ranked[k].eqNullSafe(totals[k])
    ranked = ranked.join(totals, same).select(*[ranked[k] for k in keys], "_v", (F.col("_before") + F.col("_c")).alias("_to"), "_n", "_all")

    def at(rank: F.Column) -> F.Column:
        return F.min(F.when((F.col("_to") > rank) & (F.col("_to") - F.col("_n") <= rank), F.col("_v")))

    parts = []
    for q in quantiles:
        place = (F.col("_all") - 1) * F.lit(float(q))
        low, high = at(F.floor(place)), at(F.ceil(place))
        parts.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"q{100 * q:g}".replace(".", "_")))
    return ranked.groupBy(*keys).agg(*parts)


KLL_K, HLL_K = 400, 12


def sketch(rows: DataFrame, keys: Sequence[str], value: str, item: str) -> DataFrame:
    """keys, n, kll (of ``value``) and hll (of ``item``): states that can be stored and merged."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.expr(f"kll_sketch_agg_double(CAST(`{value}` AS DOUBLE), {KLL_K})").alias("kll"),
                                   F.hll_sketch_agg(item, HLL_K).alias("hll"))


def merged(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of coarser ``keys``. States of a group are few (one a stored part), each of some KB."""
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("reduce(slice(collect_list(kll), 2, 1 << 30), element_at(collect_list(kll), 1), (a, x) -> kll_sketch_merge_double(a, x))").alias("kll"),
                                     F.hll_union_agg("hll").alias("hll"))


def estimates(states: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """keys, n, distinct and a column ``q<k>`` a quantile."""
    qs = [F.expr(f"kll_sketch_get_quantile_double(kll, {float(q)!r}D)").alias(f"q{100 * q:g}".replace(".", "_")) for q in quantiles]
    return states.select(*keys, "n", F.hll_sketch_estimate("hll").alias("distinct"), *qs)
