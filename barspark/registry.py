"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, the DuckDB reference SQL over the same tables.

Query outputs round doubles with ``r6`` (same rule as the SQL side) and widen
integers to BIGINT, so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
_MEMO: dict = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; the runtime settings the engine relies on
    (UTC, NTZ timestamps, ANSI, AQE floors) are applied to the given session."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from .session import configure
            return fn(configure(spark), sf_dir)
        run.__name__ = getattr(fn, "__name__", name)
        REG[name] = (run, sql)
        return fn
    return deco


def memo(spark: SparkSession, key: tuple, build: Callable[[], object]):
    k = (spark.sparkContext.applicationId, *key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def clear_memo(keep: tuple[str, ...] = ()) -> None:
    """Forget results; what is stored input (``keep``: first words of keys) may stay."""
    for k in [k for k in _MEMO if k[1] not in keep]:
        del _MEMO[k]


# Comparison rounding: scale, add an offset that is not a short decimal, round
# half away from zero, unscale. Values on the grid are unchanged; values with
# a finite decimal expansion (prices, means of prices) can never sit exactly on
# the rounding threshold, so engines that sum in different orders agree.
ROUND_OFFSET = 0.2345678


def r6(c, digits: int = 6):
    m = float(10 ** digits)
    return F.round(c * F.lit(m) + F.lit(ROUND_OFFSET)) / F.lit(m) + F.lit(0.0)


def finalize(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (``digits`` places, same rule as the SQL side) and widen ints."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(r6(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            # dates compare as ISO text (engines map DATE to different host types)
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def load_all() -> dict:
    from . import registry_core, registry_data, registry_series  # noqa: F401  (registration side effects)
    return REG
