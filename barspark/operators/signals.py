"""Entry filters: event blackout windows, eligibility, rejection reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P

BROADCAST_MAX_DAYS = 5_000_000


def as_col(v) -> F.Column:
    """A parameter given as a Python value or as a (per-run) column."""
    return v if isinstance(v, F.Column) else F.lit(v)


def blackout_days(events: DataFrame, days_before: int, days_after: int) -> DataFrame:
    """Distinct calendar days covered by ``[event - before, event + after]``.

    The range condition becomes an equi-join on the day: each event expands to
    ``before + after + 1`` rows, a bound fixed by the parameters.
    """
    d = F.col("event_date").cast("date")
    return (events.select(F.explode(F.sequence(F.date_sub(d, int(days_before)), F.date_add(d, int(days_after))))
                          .alias("blackout_day"))
                  .distinct())


def with_blackout(bars: DataFrame, events: DataFrame | None, days_before: int = P.DEFAULT_DAYS_BEFORE,
                  days_after: int = P.DEFAULT_DAYS_AFTER, ts: str = "ts") -> DataFrame:
    """Adds ``blackout``: the bar's calendar day lies in any event window."""
    if events is None:
        return bars.withColumn("blackout", F.lit(False))
    days = blackout_days(events, days_before, days_after)
    n = days.count()            # size check: events x window days, tiny by construction
    days = F.broadcast(days) if n <= BROADCAST_MAX_DAYS else days
    j = bars.join(days, F.to_date(F.col(ts)) == F.col("blackout_day"), "left")
    return j.withColumn("blackout", F.col("blackout_day").isNotNull()).drop("blackout_day")


def with_blackout_runs(bars: DataFrame, events: DataFrame | None, runs: list, ts: str = "ts") -> DataFrame:
    """Per-run blackout flag for bars keyed by ``run_id``.

    ``runs`` is the literal list of ``RunParams``; each event row is expanded
    once per run (a generate over a literal array) and then over that run's
    window days. The day table has at most runs x events x window-days rows,
    counted before it is broadcast, and joins on (run_id, day).
    """
    if events is None:
        return bars.withColumn("blackout", F.lit(False))
    d = F.col("event_date").cast("date")
    spec = F.array(*[F.struct(F.lit(p.run_id).alias("run_id"), F.lit(int(p.days_before)).alias("b"),
                              F.lit(int(p.days_after)).alias("a")) for p in runs])
    days = (events.select(d.alias("e"), F.explode(spec).alias("r"))
                  .select(F.col("r.run_id").alias("_bo_run"),
                          F.explode(F.sequence(F.date_sub("e", F.col("r.b")), F.date_add("e", F.col("r.a"))))
                           .alias("blackout_day"))
                  .distinct())
    n = days.count()
    days = F.broadcast(days) if n <= BROADCAST_MAX_DAYS else days
    cond = (F.col("run_id") == F.col("_bo_run")) & (F.to_date(F.col(ts)) == F.col("blackout_day"))
    j = bars.join(days, cond, "left")
    return j.withColumn("blackout", F.col("blackout_day").isNotNull()).drop("blackout_day", "_bo_run")


def conditions(hv_min=P.DEFAULT_HV_MIN, hv_max=P.DEFAULT_HV_MAX) -> dict[str, F.Column]:
    """Entry conditions; a comparison with a missing value is false. ``hv_min``
    and ``hv_max`` may be per-run columns."""
    adx, rsi, hv = F.col("adx"), F.col("rsi"), F.col("hv")
    lo = as_col(float(hv_min)) if not isinstance(hv_min, F.Column) else hv_min
    hi = as_col(float(hv_max)) if not isinstance(hv_max, F.Column) else hv_max
    return {
        "cond_adx": F.coalesce(adx < P.ADX_ENTRY_THRESHOLD, F.lit(False)),
        "cond_rsi": F.coalesce((rsi >= P.RSI_LOWER_BOUND) & (rsi <= P.RSI_UPPER_BOUND), F.lit(False)),
        "cond_hv": F.coalesce((hv >= lo) & (hv <= hi), F.lit(False)),
    }


def with_eligibility(df: DataFrame, hv_min: float = P.DEFAULT_HV_MIN, hv_max: float = P.DEFAULT_HV_MAX) -> DataFrame:
    c = conditions(hv_min, hv_max)
    out = df.select("*", *[v.alias(k) for k, v in c.items()])
    return out.withColumn("eligible", F.col("cond_adx") & F.col("cond_rsi") & F.col("cond_hv") & ~F.col("blackout"))


def rejections(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per non-eligible bar; reasons in the fixed order, ", "-joined."""
    r = F.concat_ws(", ",
                    F.when(~F.col("cond_hv"), F.lit(P.REJECT_REASONS[0])),
                    F.when(~F.col("cond_adx"), F.lit(P.REJECT_REASONS[1])),
                    F.when(~F.col("cond_rsi"), F.lit(P.REJECT_REASONS[2])),
                    F.when(F.col("blackout"), F.lit(P.REJECT_REASONS[3])))
    return (df.filter(~F.col("eligible"))
              .select(*keys, F.col("ts").alias("date"),
                      F.when(r == "", F.lit("Not eligible")).otherwise(r).alias("reasons"),
                      "adx", "rsi", "hv", "blackout"))


def rejection_reasons(rejected: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Count of each reason and its share (percent) of the rejected bars, per key."""
    keys = list(keys)
    per = (rejected.select(*keys, F.explode(F.split("reasons", ", ")).alias("reason"))
                   .groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("count")))
    tot = rejected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return (per.join(tot, keys)
               .select(*keys, "reason", "count",
                       (F.lit(100.0) * F.col("count") / F.col("_rows")).alias("pct")))


def blackout_spans(bars: DataFrame, events: DataFrame, days_before: int = P.DEFAULT_DAYS_BEFORE,
                   days_after: int = P.DEFAULT_DAYS_AFTER, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Each event's blocked span and how many bars of each key fall into it."""
    d = F.col("event_date").cast("date")
    days = events.select(d.alias("event_date"), F.date_sub(d, int(days_before)).alias("span_start"),
                         F.date_add(d, int(days_after)).alias("span_end"))
    days = days.withColumn("day", F.explode(F.sequence("span_start", "span_end")))
    n = days.count()            # events x window days: tiny by construction, checked
    days = F.broadcast(days) if n <= BROADCAST_MAX_DAYS else days
    j = bars.select(*keys, F.to_date("ts").alias("day")).join(days, "day")
    return j.groupBy(*keys, "event_date", "span_start", "span_end").agg(F.count(F.lit(1)).alias("bars_in_span"))
