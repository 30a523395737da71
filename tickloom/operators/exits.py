"""Exits of open trades and the check of entries, by bars: stops, take-profits and slippage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.joins import alive_bars, last_seen

# Fixed values: (profit above, distance of the stop), and (minutes since the opening, profit to take).
STOP_TIERS = ((0.2, 0.05), (0.1, 0.03), (0.06, 0.02), (0.03, 0.015))
BASE_STOP = -0.99
TAKE_TIERS = ((292, 0.005), (81, 0.038), (0, 0.205))
MAX_SLIP = 0.983
DAY_MS = 86_400_000


def trailing_stop(trades: DataFrame, bars: DataFrame, tiers=STOP_TIERS, base: float = BASE_STOP) -> DataFrame:
    """Of each trade (symbol, trade_id, open_time, close_time, open_rate) the first bar whose low reaches the stop: stop_time, stop_rate.

    The stop is the highest that the closes of the bars before set, and at least ``base`` under the opening rate."""
    d = alive_bars(trades, bars.select("symbol", "time", "low", "close"), DAY_MS)
    profit = F.col("close") / F.col("open_rate") - 1
    distance = F
    for least, far in tiers:
        distance = distance.when(profit > least, F.lit(far))
    w = Window.partitionBy("symbol", "trade_id").orderBy("time")
    d = d.withColumn("_stop", F.max(F.col("close") * (1 - distance)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_stop", F.greatest("_stop", F.col("open_rate") * (1 + base)))
    hit = d.where(F.col("low") <= F.col("_stop"))
    return hit.groupBy("symbol", "trade_id").agg(F.min("time").alias("stop_time"), F.min_by("_stop", "time").alias("stop_rate"))


def take_profit(trades: DataFrame, bars: DataFrame, tiers=TAKE_TIERS) -> DataFrame:
    """Of each trade the first bar whose close reaches the profit to take at its age: take_time, profit."""
    d = alive_bars(trades, bars.select("symbol", "time", "close"), DAY_MS)
    age, profit = (F.col("time") - F.col("open_time")) / 60_000, F.col("close") / F.col("open_rate") - 1
    wanted = F
    for minutes, share in tiers:
        wanted = wanted.when(age >= minutes, F.lit(share))
    hit = d.withColumn("_profit", profit).where(F.col("_profit") >= wanted)
    return hit.groupBy("symbol", "trade_id").agg(F.min("time").alias("take_time"), F.min_by("_profit", "time").alias("profit"))


def slippage_guard(orders: DataFrame, bars: DataFrame, max_slip: float = MAX_SLIP, split: bool | None = None) -> DataFrame:
    """orders (symbol, time, rate, any others) with ``accepted``: the rate isn't above the close of the last bar up to then by max_slip percent or more; without a bar, no."""
    left = orders.select("symbol", F.col("time").alias("at"), F.struct(*[F.col(c) for c in orders.columns]).alias("row"))
    right = bars.select("symbol", F.col("time").alias("at"), F.struct("close").alias("held"))
    rate, last = F.col("row.rate"), F.col("seen.close")
    accepted = F.coalesce((rate <= last) | ((F.try_divide(rate, last) - 1) * 100 < max_slip), F.lit(False))
    return last_seen(left, right, DAY_MS, split).select("row.*", accepted.alias("accepted"))


def exit_flag(df: DataFrame) -> DataFrame:
    """Adds ``exit_long``: 0 where there is volume, else null."""
    return df.withColumn("exit_long", F.when(F.col("volume") > 0, 0))
