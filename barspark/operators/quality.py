"""Validation (one grouped aggregate per key) and cleaning of raw bars.

Raw bars carry ``timestamp`` as text. Validation never collects: every check
is a conditional count in the same aggregate, messages are built from the
counts, and the report is one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..schemas import BAR_COLUMNS, REQUIRED_BACKTEST

# Patterns of timestamps that are not ISO, tried in order.
TIMESTAMP_FORMATS = ["yyyy/M/d[ H:mm[:ss]]", "M/d/yyyy[ H:mm[:ss]]"]
ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}($|[ T])"
OFFSET = r":\d{2}(\.\d+)? ?([Zz]|[+-]\d{2}(:?\d{2})?)$"


def parse_ts(c: Column | str) -> Column:
    """Wall-clock time of a text: ISO with any fraction, ``T`` or blank, and with an
    offset (converted to UTC), or one of ``TIMESTAMP_FORMATS``; else NULL."""
    col = F.col(c) if isinstance(c, str) else c
    s = F.trim(col.cast("string"))
    iso = F.when(s.rlike(ISO_DAY), s)
    zoned = F.when(iso.rlike(OFFSET), F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.try_cast("timestamp_ltz").cast("timestamp_ntz"))
    plain = F.when(~F.coalesce(iso.rlike(OFFSET), F.lit(False)), iso).try_cast("timestamp_ntz")
    other = [F.try_to_timestamp(F.when(~s.rlike(ISO_DAY), s), F.lit(f)).cast("timestamp_ntz") for f in TIMESTAMP_FORMATS]
    return F.coalesce(plain, utc, *other)


def number(c: Column) -> Column:
    """A double from text or number; text that is no number, and NaN, are NULL."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_BACKTEST) -> list[str]:
    """Schema-only check (no job)."""
    return sorted(set(required) - set(df.columns))


def profile(raw: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """All validation counts in one aggregate per key."""
    ts = parse_ts("timestamp")
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.count_if(ts.isNull()).alias("invalid_timestamps"),
            F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"),
            (F.count(F.lit(1)) - F.count_distinct(F.coalesce(F.col("timestamp").cast("string"), F.lit("\u0000"))))
            .alias("duplicate_timestamps"),
            F.count_if(F.col("high") < F.col("low")).alias("inverted_bars")]
    for c in BAR_COLUMNS:
        aggs += [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).try_cast("double"))).alias(f"{c}_nulls")]
    return raw.groupBy(*keys).agg(*aggs)


def validation_report(raw: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """is_valid, errors, warnings (arrays, fixed message texts), row_count, ts range."""
    missing = missing_columns(raw)
    if missing:
        msg = "Missing required columns: {" + ", ".join(f"'{m}'" for m in missing) + "}"
        return (raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
                   .select(*keys, F.lit(False).alias("is_valid"), F.array(F.lit(msg)).alias("errors"),
                           F.array().cast("array<string>").alias("warnings"), "row_count",
                           F.lit(None).cast("timestamp_ntz").alias("ts_min"),
                           F.lit(None).cast("timestamp_ntz").alias("ts_max")))
    p = profile(raw, keys)
    n = F.col("row_count")
    errors = [F.when(n < P.MIN_ROWS, F.format_string(f"Insufficient data: %d rows (minimum {P.MIN_ROWS} required)", n)),
              F.when(F.col("invalid_timestamps") == n, F.lit("No valid timestamps found"))]
    errors += [F.when(F.col(f"{c}_nulls") == n, F.lit(f"Column '{c}' contains all NaN values")) for c in BAR_COLUMNS]
    warnings = [F.when(F.col("invalid_timestamps") > 0,
                       F.format_string("%d invalid timestamps will be dropped", F.col("invalid_timestamps"))),
                F.when(F.col("duplicate_timestamps") > 0,
                       F.format_string("%d duplicate timestamps will be deduplicated", F.col("duplicate_timestamps")))]
    warnings += [F.when((F.col(f"{c}_nulls") > 0) & (F.col(f"{c}_nulls") < n),
                        F.format_string(f"Column '{c}' has %d missing values", F.col(f"{c}_nulls")))
                 for c in BAR_COLUMNS]
    warnings += [F.when(F.col("inverted_bars") > 0,
                        F.format_string("%d bars have HIGH < LOW (will be corrected)", F.col("inverted_bars")))]
    e = F.array_compact(F.array(*errors))
    w = F.array_compact(F.array(*warnings))
    return p.select(*keys, (F.size(e) == 0).alias("is_valid"), e.alias("errors"), w.alias("warnings"),
                    "row_count", "ts_min", "ts_max")


def clean_bars(raw: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "seq") -> DataFrame:
    """Parse time (invalid -> dropped), keep the first row per timestamp in
    input order, then drop rows missing a price, then swap inverted high/low.

    Keep-first is one ``min_by`` a column on the input position, which is unique
    (a partial hash aggregate, so one hot timestamp does not land in one task and
    nothing is sorted); it runs before the null filter, so a first duplicate with
    a missing price removes the timestamp altogether.
    """
    keys = list(keys)
    t = raw.withColumn("ts", parse_ts("timestamp")).filter(F.col("ts").isNotNull())
    payload = [c for c in raw.columns if c not in (*keys, "timestamp")]
    first = (t.groupBy(*keys, "ts")
              .agg(*[(F.min(c) if c == order else F.min_by(c, order)).alias(c) for c in payload]))
    kept = first.dropna(subset=BAR_COLUMNS)
    inv = F.col("high") < F.col("low")
    return kept.withColumn("_h", F.when(inv, F.col("low")).otherwise(F.col("high"))) \
               .withColumn("low", F.when(inv, F.col("high")).otherwise(F.col("low"))) \
               .drop("high").withColumnRenamed("_h", "high") \
               .select(*keys, "ts", *payload)
