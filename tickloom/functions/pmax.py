"""The profit maximiser: a trend line that follows one of two ratcheting bands.

Each band depends on its own last value and on comparisons with the average, so it is no linear
recurrence; it is a step of the pass along a series, which keeps only the bands from batch to batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.indicators import KEYS, atr, moving_average
from tickloom.functions.scan import Step, recurrences


def pmax(df: DataFrame, kind: str = "ema", length: int = 9, multiplier: int = 27, period: int = 10, source: int = 3) -> DataFrame:
    """Adds ``pm`` and ``pmx`` (up, down or null). source: 1 the close, 2 the middle of high and low, 3 the mean of the four prices."""
    x = {1: F.col("close"), 2: (F.col("high") + F.col("low")) / 2, 3: (F.col("high") + F.col("low") + F.col("close") + F.col("open")) / 4}[source]
    d = atr(df, period).withColumn("_close", F.col("close")).withColumn("close", x)
    d = moving_average(d, kind, length, "_average").withColumn("close", F.col("_close")).drop("_close")
    d = recurrences(d, KEYS, [Step("pm", "trail", "_average", period, multiplier / 10, f"atr_{period}")])
    side = F.when(F.col("pm") > 0, F.when(F.col("_average") < F.col("pm"), "down").otherwise("up"))
    return d.withColumn("pmx", side).select(*df.columns, "pm", "pmx")
