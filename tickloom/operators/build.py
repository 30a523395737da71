"""Candles from rows with a price, and coarser candles from finer ones; the table of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Level token, length in ms (null: calendar month), periods in a year by integer division.
LEVELS = (
    ("1m", 60_000, 525_600), ("3m", 180_000, 175_200), ("5m", 300_000, 105_120), ("15m", 900_000, 35_040), ("30m", 1_800_000, 17_520),
    ("1h", 3_600_000, 8_760), ("2h", 7_200_000, 4_380), ("4h", 14_400_000, 2_190), ("6h", 21_600_000, 1_460), ("12h", 43_200_000, 730),
    ("1d", 86_400_000, 365), ("3d", 259_200_000, 121), ("1w", 604_800_000, 52), ("1M", None, 12),
)


def levels(spark: SparkSession) -> DataFrame:
    """(level, length_ms, periods_per_year), a row for each level."""
    return spark.createDataFrame([*LEVELS], "level string, length_ms long, periods_per_year int")


def parse_level(token: Column) -> Column:
    """The level of a token, null if it names none. ``1mo`` is another name of a month, and ``1m`` a minute."""
    return F.when(token == "1mo", "1M").when(token.isin(*[x[0] for x in LEVELS]), token)


def periods_per_year(level: str) -> int:
    return {x[0]: x[2] for x in LEVELS}[level]


def bar_start(ts: Column, level: str) -> Column:
    """Where the bar of a timestamp begins, in ms since the epoch, UTC. Weeks begin on Monday."""
    length = {x[0]: x[1] for x in LEVELS}[level]
    ms = F.unix_millis(ts.cast("timestamp"))
    if level == "1w":
        return F.unix_millis(F.date_trunc("week", ts.cast("timestamp")))
    if length is None:
        return F.unix_millis(F.date_trunc("month", ts.cast("timestamp")))
    return ms - F.pmod(ms, F.lit(length))


def _bars(df: DataFrame, first: Column, last: Column) -> DataFrame:
    return df.groupBy("symbol", "level", "time").agg(F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", last).alias("close"), F.sum("volume").alias("volume"))


def build_candles(ticks: DataFrame, level: str) -> DataFrame:
    """Candles of rows (symbol, ts, seq, price, volume): open and close are the first and last price by (ts, seq)."""
    own = ticks.select("symbol", F.lit(level).alias("level"), bar_start(F.col("ts"), level).alias("time"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume", F.struct("ts", "seq").alias("at"))
    return _bars(own, F.col("at"), F.col("at"))


def rollup(candles: DataFrame, level: str) -> DataFrame:
    """Coarser candles of finer ones."""
    own = candles.withColumn("at", F.col("time")).withColumn("time", bar_start(F.timestamp_millis("time"), level)).withColumn("level", F.lit(level))
    return _bars(own, F.col("at"), F.col("at"))


def events_as_ticks(events: DataFrame) -> DataFrame:
    """The events table as ticks: a symbol for each event type, its value as the price, ``props.k`` as the volume."""
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


def orders_as_ticks(orders: DataFrame) -> DataFrame:
    """The orders table as ticks: a symbol for each priority, the total as the price, one order as the volume."""
    return orders.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))
