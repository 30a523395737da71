"""Analytics over closed trades (symbol, open_time, close_time in ms, profit_ratio, profit_abs, exit_reason)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
SLIPPAGE = 0.0005


def day_of(ms: str) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def with_slippage(trades: DataFrame, slippage: float = SLIPPAGE) -> DataFrame:
    return trades.withColumn("profit_after_slippage", F.col("profit_ratio") - slippage)


def calendar(bars: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each day from that of the first bar to that of the last, by the keys; none without bars."""
    day = day_of("time")
    return bars.groupBy(*keys).agg(F.min(day).alias("a"), F.max(day).alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("day"))


def daily_profit(trades: DataFrame, days: DataFrame, keys: tuple[str, ...] = (), slippage: float = SLIPPAGE) -> DataFrame:
    """A row for each of the days: the sum of the slippage-adjusted profits of trades closed that day, 0 without any."""
    own = with_slippage(trades, slippage).groupBy(*keys, day_of("close_time").alias("day")).agg(F.sum("profit_after_slippage").alias("profit"))
    return days.join(own, [*keys, "day"], "left").select(*keys, "day", F.coalesce("profit", F.lit(0.0)).alias("profit"))


def daily_sharpe(daily: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean over sample deviation of the daily profits, by the year; -20 without variation. One row, or one for each of the keys."""
    sd = F.stddev_samp("profit")
    return daily.groupBy(*keys).agg(F.when(sd > 0, F.avg("profit") / sd * F.sqrt(F.lit(365.0))).otherwise(F.lit(-20.0)).alias("sharpe"))


def daily_equity(daily: DataFrame) -> DataFrame:
    """Each day with the sum of the profits of all days before it. Days are few: one row for each."""
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select("day", F.coalesce(F.sum("profit").over(w), F.lit(0.0)).alias("equity"))


def win_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    won = F.count_if(F.col("profit_ratio") > 0)
    return trades.groupBy(*keys).agg(F.count("*").alias("trades"), won.alias("wins"), F.sum("profit_abs").alias("profit"), (won / F.count("*")).alias("win_rate"))


def underwater(trades: DataFrame, balance: float, keys: list[str]) -> DataFrame:
    """Per trade, in order of closing: cumulated profit, its peak and when that was last reached (null: before any trade), and the falls from it in money and as a share of the balance at the peak."""
    w = Window.partitionBy(*keys).orderBy("close_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    d = trades.withColumn("cumulated", F.sum("profit_abs").over(w)).withColumn("high", F.greatest(F.max("cumulated").over(w), F.lit(0.0)))
    d = d.withColumn("high_at", F.last(F.when((F.col("cumulated") == F.col("high")) & (F.col("high") > 0), F.col("close_time")), ignorenulls=True).over(w))
    return d.select(*keys, "trade_id", "close_time", "cumulated", "high", "high_at", (F.col("cumulated") - F.col("high")).alias("drawdown"), ((F.col("high") - F.col("cumulated")) / (balance + F.col("high"))).alias("drawdown_share"))


def worst_drawdown(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: deepest fall in money and as a share, when the deepest began (null: with the first trade) and when it was reached."""
    return curve.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"), F.max("drawdown_share").alias("max_share"), F.min_by("high_at", F.struct("drawdown", "close_time")).alias("began_at"), F.min_by("close_time", F.struct("drawdown", "close_time")).alias("low_at"))


def loss_score(profit_percent: Column, drawdown_share: Column, sharpe: Column) -> Column:
    """Lower is better: 50 without drawdown or from a profit of 200 percent on, else -profit / (1 / (1 - drawdown) - 1) * Sharpe."""
    cost = F.try_divide(F.lit(1.0), 1 - drawdown_share) - 1
    return F.when(cost == 0, 50.0).when(profit_percent < 200, -profit_percent / cost * sharpe).otherwise(50.0)


def exit_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol", "exit_reason").agg(F.count("*").alias("n"))


def parallelism(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Open trades at each bar time that occurs: the opening included, the closing excluded; openings less closings of all days before, and of the day so far."""
    steps = trades.select(F.col("open_time").alias("time"), F.lit(1).alias("step")).unionAll(trades.select(F.col("close_time").alias("time"), F.lit(-1).alias("step"))).groupBy("time").agg(F.sum("step").alias("step"))
    times = bars.select("time").distinct().join(steps, "time", "full").select("time", F.coalesce("step", F.lit(0)).alias("step"), F.floor(F.col("time") / DAY_MS).alias("day"))
    before = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    days = times.groupBy("day").agg(F.sum("step").alias("step")).select("day", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("open_before"))
    so_far = Window.partitionBy("day").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return times.join(F.broadcast(days), "day").select("time", (F.col("open_before") + F.sum("step").over(so_far)).alias("open_trades"))


def profit_hist(trades: DataFrame, bin_size: float = 0.01) -> DataFrame:
    return trades.groupBy(F.floor(F.col("profit_ratio") / bin_size).alias("bin")).agg(F.count("*").alias("n"))


def pair_results(trades: DataFrame) -> DataFrame:
    return trades.groupBy("symbol").agg(F.count("*").alias("trades"), F.avg("profit_ratio").alias("mean_profit"), F.sum("profit_abs").alias("profit"))


def compare_strategies(results: dict[str, DataFrame]) -> DataFrame:
    """A row for each strategy's trades: their number, mean and summed profit, and the share won."""
    won = F.count_if(F.col("profit_ratio") > 0)
    rows = [t.agg(F.count("*").alias("trades"), F.avg("profit_ratio").alias("mean_profit"), F.sum("profit_abs").alias("profit"), F.try_divide(won, F.count("*")).alias("win_rate")).withColumn("strategy", F.lit(name)) for name, t in results.items()]
    return reduce(DataFrame.unionByName, rows).select("strategy", "trades", "mean_profit", "profit", "win_rate")


def market_change(candles: DataFrame) -> DataFrame:
    """One row: mean over the series of the change from the first to the last close."""
    own = candles.groupBy("symbol", "level").agg(F.min_by("close", "time").alias("a"), F.max_by("close", "time").alias("b"))
    return own.agg(F.avg(F.col("b") / F.col("a") - 1).alias("market_change"))
