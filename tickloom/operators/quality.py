"""Order, duplicates, gaps, merging and freshness of candle series. A series is one (symbol, level)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["symbol", "level"]
DAY_MS = 86_400_000


def normalize(df: DataFrame, *arrival: str) -> DataFrame:
    """One row for each time of a series: the first to arrive, by the columns ``arrival``, wins."""
    w = Window.partitionBy(*SERIES, "time").orderBy(*arrival)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def normalize_report(df: DataFrame, arrival: str) -> DataFrame:
    """Per series: whether times fall in order of arrival, rows with a time seen before, and whether normalizing changes anything."""
    before = F.lag("time").over(Window.partitionBy(*SERIES).orderBy(arrival))
    found = df.withColumn("_before", before).groupBy(*SERIES).agg(
        F.coalesce(F.bool_or(F.col("time") < F.col("_before")), F.lit(False)).alias("was_unsorted"), (F.count("*") - F.countDistinct("time")).alias("removed_duplicates")
    )
    return found.withColumn("changed", F.col("was_unsorted") | (F.col("removed_duplicates") > 0))


def check_increasing(df: DataFrame, arrival: str) -> DataFrame:
    """The pairs (previous, time) in order of arrival in which time doesn't rise; none for a good series."""
    before = F.lag("time").over(Window.partitionBy(*SERIES).orderBy(arrival))
    return df.withColumn("previous", before).where(F.col("time") <= F.col("previous")).select(*SERIES, "previous", "time")


def gaps(df: DataFrame) -> DataFrame:
    """Every gap between neighbouring bars, with the one that the series begins with as ``expected``."""
    w = Window.partitionBy(*SERIES).orderBy("time")
    d = df.select(*SERIES, "time", (F.col("time") - F.lag("time").over(w)).alias("gap")).where("gap is not null")
    return d.withColumn("expected", F.first("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def interval_check(df: DataFrame) -> DataFrame:
    """Per series: whether all gaps equal the first, and the largest of the first and those that differ; (true, 0) up to one bar."""
    found = gaps(df).groupBy(*SERIES).agg(F.bool_and(F.col("gap") == F.col("expected")).alias("constant"), F.max(F.greatest("gap", "expected")).alias("max_gap"))
    return df.select(*SERIES).distinct().join(found, SERIES, "left").select(*SERIES, F.coalesce("constant", F.lit(True)).alias("constant"), F.coalesce("max_gap", F.lit(0)).cast("long").alias("max_gap"))


def merge_candles(existing: DataFrame, new: DataFrame, *arrival: str) -> DataFrame:
    """Both tables' rows, one for each time: an existing row wins over a new one, and of new ones the first by the columns ``arrival`` of new (then by its prices)."""
    columns = existing.columns
    order = [f"_a{k}" for k in range(len(arrival))]
    old = existing.withColumns({"_from": F.lit(0), **{a: F.lit(None).cast(new.schema[c].dataType) for a, c in zip(order, arrival, strict=True)}})
    own = new.select(*columns, F.lit(1).alias("_from"), *[F.col(c).alias(a) for a, c in zip(order, arrival, strict=True)])
    rest = [c for c in columns if c not in (*SERIES, "time")]
    return normalize(old.unionByName(own), "_from", *order, *rest).select(*columns)


def last_candle(df: DataFrame) -> DataFrame:
    """The last bar's time of each series."""
    return df.groupBy(*SERIES).agg(F.max("time").alias("last_time"))


def boundaries(df: DataFrame) -> DataFrame:
    """First and last date of each series, UTC."""
    date = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")
    return df.groupBy(*SERIES).agg(F.min("time").alias("a"), F.max("time").alias("b")).select(*SERIES, date("a").alias("first_date"), date("b").alias("last_date"))


def freshness_plan(candles: DataFrame, wanted: DataFrame, now_ms: int, start_ms: int, force: bool = False, limit_ms: int = 2 * DAY_MS) -> DataFrame:
    """For each wanted series: its age, whether it is fresh, and from where to fetch (null: nothing)."""
    d = wanted.join(last_candle(candles), SERIES, "left")
    age = F.greatest(F.lit(0).cast("long"), F.lit(now_ms).cast("long") - F.col("last_time"))
    fresh = F.coalesce(age < limit_ms, F.lit(False)) & F.lit(not force)
    begin = F.when(fresh, None).when(F.col("last_time").isNull() | F.lit(force), F.lit(start_ms).cast("long")).otherwise(F.col("last_time") + 1)
    return d.select(*SERIES, "last_time", age.alias("age_ms"), fresh.alias("fresh"), begin.alias("fetch_from"))


def universe(df: DataFrame, allow: list[str], deny: list[str], min_days: int, now_ms: int) -> DataFrame:
    """Allowed symbols, less the denied ones, that were first seen at least min_days ago."""
    own = df.where(F.col("symbol").isin(allow) & ~F.col("symbol").isin(deny)).groupBy("symbol").agg(F.min("time").alias("listed"))
    return own.where(F.col("listed") <= now_ms - min_days * DAY_MS)


def preview(df: DataFrame, start_ms: int, end_ms: int, n: int, last: bool = False) -> DataFrame:
    """The first or last n bars from start to end, end excluded, over all series."""
    return df.where((F.col("time") >= start_ms) & (F.col("time") < end_ms)).orderBy(F.desc("time") if last else F.asc("time"), "symbol").limit(n)


def bar_number(order: str = "time", keys: list[str] = SERIES) -> Column:
    """0 for the first bar of a series."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
