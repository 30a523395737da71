"""Joins of bars with coarser bars, parameters, averages and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scan import SPLIT_BYTES, STRETCH, estimated_bytes


def last_seen(left: DataFrame, right: DataFrame, span_ms: int, split: bool | None = None) -> DataFrame:
    """left (symbol, at, row) with ``seen``: the held of the last row of right (symbol, at, held) up to then; rows of right come before those of left at equal times.

    One window over both tables' rows. A large table is cut into stretches of span_ms, windows of their own: each begins with
    what was last seen before it, which follows from one row for each stretch that holds rows of right."""
    held, row = right.schema["held"].dataType, left.schema["row"].dataType
    rows = left.select("symbol", "at", F.lit(1).alias("_side"), "row", F.lit(None).cast(held).alias("held"))
    rows = rows.unionByName(right.select("symbol", "at", F.lit(0).alias("_side"), F.lit(None).cast(row).alias("row"), "held"))
    keys = ["symbol"]
    if estimated_bytes(rows) >= SPLIT_BYTES if split is None else split:
        keys, stretch = ["symbol", "_stretch"], F.floor(F.col("at") / span_ms).alias("_stretch")
        rows = rows.select("*", stretch)
        lasts = right.select("symbol", stretch, "at", "held").groupBy("symbol", "_stretch").agg(F.max_by("held", "at").alias("held"))
        ends = left.select("symbol", stretch).groupBy("symbol").agg(F.max("_stretch").alias("_last"))
        later = F.lead("_stretch").over(Window.partitionBy("symbol").orderBy("_stretch"))  # one row for each stretch
        reach = lasts.withColumn("_next", later).join(ends, "symbol").withColumn("_to", F.least(F.coalesce("_next", "_last"), "_last"))
        begins = reach.where("_to > _stretch").select("symbol", F.explode(F.sequence(F.col("_stretch") + 1, F.col("_to"))).alias("_stretch"), "held")
        rows = rows.unionByName(begins.select("symbol", (F.col("_stretch") * span_ms).alias("at"), F.lit(-1).alias("_side"), F.lit(None).cast(row).alias("row"), "held", "_stretch"))
    w = Window.partitionBy(*keys).orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("seen", F.last("held", ignorenulls=True).over(w)).where("_side = 1").select("symbol", "at", "row", "seen")


def asof_merge(base: DataFrame, coarse: DataFrame, columns: list[str], suffix: str, base_ms: int, coarse_ms: int, split: bool | None = None) -> DataFrame:
    """Every base bar with the columns of the last coarse bar that had closed by the base bar's close, no look-ahead."""
    left = base.select("symbol", (F.col("time") + base_ms).alias("at"), F.struct(*[F.col(c) for c in base.columns]).alias("row"))
    right = coarse.select("symbol", (F.col("time") + coarse_ms).alias("at"), F.struct(*[F.col(c).alias(f"{c}{suffix}") for c in columns]).alias("held"))
    return last_seen(left, right, base_ms * STRETCH, split).select("row.*", "seen.*")


#: Parameter rows that are sent to every task; more of them are dealt by shuffling.
MOST_BROADCAST = 1 << 20


def small(params: DataFrame) -> DataFrame:
    """params, to be broadcast if they are few: they are counted first."""
    return F.broadcast(params) if params.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else params


def pair_emas(grid: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Each bar with the fast and the slow average of each parameter row (fast, slow); grid has (keys, time, period, ema)."""
    sides = small(params.select(F.posexplode(F.array("fast", "slow")).alias("side", "period"), "fast", "slow"))
    own = grid.join(sides, "period")
    rest = [c for c in grid.columns if c not in (*keys, "time", "period", "ema")]
    return own.groupBy(*keys, "fast", "slow", "time").agg(*[F.first(c).alias(c) for c in rest], F.max(F.when(F.col("side") == 0, F.col("ema"))).alias("ema_fast"), F.max(F.when(F.col("side") == 1, F.col("ema"))).alias("ema_slow"))


def alive_bars(trades: DataFrame, bars: DataFrame, bucket_ms: int) -> DataFrame:
    """Each trade with the bars from its opening to its closing time, both included; an interval join by buckets of time."""
    span = F.sequence(F.floor(F.col("open_time") / bucket_ms), F.floor(F.col("close_time") / bucket_ms))
    left = trades.withColumn("_bucket", F.explode(span))
    right = bars.withColumn("_bucket", F.floor(F.col("time") / bucket_ms))
    return left.join(right, ["symbol", "_bucket"]).where(F.col("time").between(F.col("open_time"), F.col("close_time"))).drop("_bucket")
