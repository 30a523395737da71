"""Times the headline queries on the tables in $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.operators import backtest as bt  # noqa: E402
from tickloom.plans import registry  # noqa: E402

HEADLINE = ["candles_hourly", "ema_grid", "backtest", "sweep", "sweep_top3", "sweep_single_best", "trades", "asof_merge", "rsi", "bollinger"]


def wide_sweep(spark: SparkSession, sf_dir: str):
    """325 pairs of averages on 15-minute candles of every symbol."""
    return bt.rank(bt.backtest(registry.build.build_candles(registry.ticks(spark, sf_dir), "15m"), bt.DoubleEma(5, 6, 30), "15m"), ["fast", "slow"], 1)


#: Bars of the made-up series, 15 minutes each, and the longest average of its grid: as many bars as in the published run, a part of its pairs.
LONG_BARS, LONG_MOST = 187_000, 100


def long_sweep(spark: SparkSession):
    """All pairs of averages from 5 to LONG_MOST over one long series."""
    k = F.col("id")
    step = (F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000.0 - 1.0) * 0.007
    walk = F.sum(step).over(Window.partitionBy(F.lit(0)).orderBy("id").rowsBetween(Window.unboundedPreceding, 0))  # one series
    bars = spark.range(LONG_BARS).select(F.lit("A-B").alias("symbol"), F.lit("15m").alias("level"), (k * 900_000).alias("time"), (100 * F.exp(walk) * (1 + step / 10)).alias("open"), (100 * F.exp(walk)).alias("close"))
    return bt.backtest(bars, bt.DoubleEma(5, 6, LONG_MOST), "15m")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: registry.QUERIES[name] for name in HEADLINE} | {"wide_sweep_15m": wide_sweep}
    runs["candles_hourly"](spark, sf_dir).count()  # starts Spark
    took = {}
    for name, run in runs.items():
        began = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    began = time.perf_counter()
    pairs = long_sweep(spark).count()
    sec = time.perf_counter() - began
    long = {"pairs": pairs, "bars": LONG_BARS, "sec": round(sec, 3), "bar_evaluations_per_sec": round(pairs * LONG_BARS / sec)}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "long_sweep": long, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
