"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sampling picks rows whose hash lies below a threshold; two values of the hash's
#: resolution keep the expected size near the bound, and the caller sorts and cuts.
SLACK = 1.2


def by_label(rows: DataFrame, label: str, per_label: int, key: list[str]) -> DataFrame:
    """At most about ``per_label`` different rows of each label value, chosen by a hash of ``key``.

    Different rows are counted first (by a sketch that combines in the tasks, so that copies of a row do not
    crowd out a label); the choice is a filter, so no label's rows meet in one task. Every value takes part: the values are the classes of a model that
    the driver holds anyway. Equal rows are drawn together and given once.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(
        F.approx_count_distinct(F.xxhash64(*key)).alias("count")).orderBy("label").collect()
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.label, min(1.0, SLACK * per_label / max(1, r["count"])))])
    draw = F.pmod(F.xxhash64(*key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(F.col(label).isNotNull() & (draw < F.try_element_at(share, F.col(label).cast("string")))).dropDuplicates()
