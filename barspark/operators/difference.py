"""Rows in which two stores differ (EXCEPT ALL both ways), reading only unequal blocks.

A block is a (symbol, year). Each side's blocks are summed up by the number of rows and
two order-free sums of row digests; blocks with equal summaries are equal. Where the
stores are partitioned by those columns, the filter on the unequal blocks prunes the scan
of the others; in them, rows are counted with a sign and what does not cancel is given
as often as it is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unequal blocks that are named in the filter; with more, the blocks are joined.
NAMED = 500


def summaries(rows: DataFrame, block: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """block, n, d1, d2. Sums wrap around; two of 64 bits with different seeds."""
    digest = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), digest(1).alias("d1"), digest(2).alias("d2"))


def unequal_blocks(a: DataFrame, b: DataFrame, block: Sequence[str], columns: Sequence[str]) -> DataFrame:
    named = [*block, "n", "d1", "d2"]
    x, y = (summaries(df, block, columns).select(*[F.col(c).alias(p + c) for c in named]) for df, p in ((a, "_x"), (b, "_y")))
    same = lambda cols: F.expr(" AND ".join(f"`_x{c}` <=> `_y{c}`" for c in cols))
    return x.join(y, same(block), "full").where(~same(named)).select(*[F.coalesce(f"_x{c}", f"_y{c}").alias(c) for c in block])


def difference(a: DataFrame, b: DataFrame, block: Sequence[str]) -> DataFrame:
    """side ('a': only there, 'b'), times, and the columns of ``a`` of the rows that differ; nulls equal nulls."""
    columns = list(a.columns)
    b = b.select(*columns)
    blocks = unequal_blocks(a, b, block, columns)
    named = blocks.limit(NAMED + 1).collect()

    def read(df: DataFrame) -> DataFrame:
        if len(named) > NAMED:
            names = blocks.select(*[F.col(c).alias(f"_x{c}") for c in block])
            return df.join(names, F.expr(" AND ".join(f"`_x{c}` <=> `{c}`" for c in block)), "left_semi")
        keep = F.lit(False)
        for r in named:
            one = F.lit(True)
            for c in block:
                one = one & (F.col(c).isNull() if r[c] is None else F.col(c) == F.lit(r[c]))
            keep = keep | one
        return df.where(keep)

    signed = read(a).withColumn("_d", F.lit(1)).unionByName(read(b).withColumn("_d", F.lit(-1)))
    left = signed.groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return left.select(F.when(F.col("_d") > 0, "a").otherwise("b").alias("side"), F.abs("_d").alias("times"), *columns)
