"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

One warm-up, then the median of three timed runs per query. Each run starts
from an empty query memo, builds the plan and executes it completely into the
no-op sink (no driver collect), so the time is the whole pipeline of that
query from the Parquet tables. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["resample_bars", "indicators_all", "backtest", "trades", "equity_curve", "rejections",
            "validation_report", "clean_bars", "bars_range", "list_symbols", "save_run"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from barspark.registry import clear_memo, load_all
    from barspark.session import get_spark

    # local mode runs every task inside the driver JVM: size its heap like an executor
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = load_all()

    def run(name: str) -> float:
        clear_memo(keep=("store",))                         # the stored bar table is input; its own write is the warm-up's
        t0 = time.perf_counter()
        reg[name][0](spark, sf_dir).write.mode("overwrite").format("noop").save()
        return time.perf_counter() - t0

    times = {}
    for q in only:
        run(q)                                              # warm-up
        times[q] = round(statistics.median(run(q) for _ in range(runs)), 3)

    ticks = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    bars = reg["resample_bars"][0](spark, sf_dir).count()
    extra = {}
    if "resample_bars" in times:
        extra["resample_ticks_per_sec"] = round(ticks / times["resample_bars"], 1)
    if "indicators_all" in times:
        extra["indicators_bars_per_sec"] = round(bars / times["indicators_all"], 1)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "backtest_sec", "value": times.get("backtest", sum(times.values())), "unit": "sec",
           "queries": times, "total_sec": round(sum(times.values()), 3), "sf": sf, "cpus": int(cpus),
           "ticks": ticks, "bars": bars, **extra}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
