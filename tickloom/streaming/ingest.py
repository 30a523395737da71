"""Incremental ingest: landed exchange payloads into a candle table, and candles from a stream of ticks."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.build import LEVELS, bar_start
from tickloom.operators.quality import SERIES, check_increasing, merge_candles
from tickloom.sources.candles import SCHEMA, exists, parse_klines, period, read_candles, write_candles

DAY_MS = 86_400_000
LANDED = "symbol string, level string, payload string"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Symbols and periods of a batch by which folders are picked; of more, only the periods are.
MOST_NAMED = 1000


def touched(new: DataFrame) -> Column:
    """The folders of the table that new rows belong to, or few others."""
    folders = new.select("symbol", "level", period().alias("period"))
    named = folders.agg(F.collect_set("period").alias("periods")).first()["periods"]  # months and years: few
    where = F.col("period").isin(named) if named else F.lit(False)
    symbols = [r["symbol"] for r in folders.select("symbol").distinct().limit(MOST_NAMED + 1).collect()]
    return where & F.col("symbol").isin(symbols) if len(symbols) <= MOST_NAMED else where


def _merge(spark: SparkSession, new: DataFrame, table: str, work: str, *arrival: str) -> None:
    """Merge new candles into the periods of series that they touch; an existing candle wins. Written aside first, as the plan reads the table.

    Periods are replaced one by one: a batch that is broken off and repeated finds its own candles there and gives the same table.
    Only a table that the file system doesn't have counts as new; a table that can't be read is an error and stays as it is."""
    new = new.withColumn("volume", F.lit(None).cast("double"))
    old = spark.createDataFrame([], SCHEMA)
    if exists(spark, table):
        own = [*SERIES, "period"]
        there = read_candles(spark, table, touched(new)).withColumn("period", period())
        old = there.join(F.broadcast(new.select(*SERIES, period().alias("period")).distinct()), own, "left_semi").select(*SCHEMA.names)  # the folders of one batch
    merge_candles(old, new, *arrival).write.mode("overwrite").parquet(work)
    merged = spark.read.schema(SCHEMA).parquet(work)
    if not merged.isEmpty():
        if not check_increasing(merged.withColumn("arrival", F.col("time")), "arrival").isEmpty():
            raise ValueError("times don't rise")
        write_candles(merged, table)
    delete(spark, work)


def ingest_stream(spark: SparkSession, landing: str, table: str, checkpoint: str):
    """Take in all landed files (Parquet: symbol, level, payload) that weren't taken in before, and stop.

    Of two bars of one time the one of the earlier file (by modification time, then path), row and place in the payload counts. Bad rows
    go to a folder beside the table, one for each batch, which a repeated batch replaces."""

    def batch(df: DataFrame, number: int) -> None:
        landed = f"{checkpoint}/landed-{number}"
        df.write.mode("overwrite").parquet(landed)  # parsed twice, read from the source once
        good, bad = parse_klines(spark.read.schema(df.schema).parquet(landed))
        bad.write.mode("overwrite").parquet(f"{table.rstrip('/')}-bad/batch={number}")
        _merge(spark, good, table, f"{checkpoint}/merged-{number}", "landed_at", "file", "row", "place")
        delete(spark, landed)

    meta = lambda name, to: F.col(f"_metadata.{name}").alias(to)
    stream = spark.readStream.schema(LANDED).parquet(landing).select("*", meta("file_modification_time", "landed_at"), meta("file_path", "file"), meta("row_index", "row"))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def candle_stream(ticks: DataFrame, level: str, late: str = "1 hour") -> DataFrame:
    """Candles of a stream of ticks (symbol, ts, seq, price, volume) at any level but the month, whose bars have no fixed length (``candle_streams`` has it); a bar is given once no tick of it can come any more."""
    own = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    length = {x[0]: x[1] for x in LEVELS}[level]
    if length is None:
        raise ValueError("months have no fixed length: roll up a stream's days instead")
    start = "4 days" if level == "1w" else "0 seconds"  # 1970-01-05 was a Monday
    at = F.struct("ts", "seq")
    bars = own.groupBy(F.window("ts", f"{length} milliseconds", startTime=start), "symbol").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return bars.select("symbol", F.lit(level).alias("level"), bar_start(F.col("window.start"), level).alias("time"), "open", "high", "low", "close", "volume")


def bar_end(start: int, level: str) -> int:
    """The end of the bar that begins at start, in ms since the epoch, UTC."""
    length = {x[0]: x[1] for x in LEVELS}[level]
    if length is not None:
        return start + length
    first = datetime.fromtimestamp(start / 1000, UTC)
    return int(first.replace(year=first.year + first.month // 12, month=first.month % 12 + 1).timestamp() * 1000)


BARS = "symbol string, level string, time long, open double, high double, low double, close double, volume double"
#: What is kept of a bar: first and last tick as (ts, seq, price), highest and lowest price, volume (none: null).
HELD = "bars string"


def _starts(ms: np.ndarray, level: str) -> np.ndarray:
    length = {x[0]: x[1] for x in LEVELS}[level]
    if level == "1w":
        return ms - (ms - 4 * DAY_MS) % length  # 1970-01-05 was a Monday
    return ms.astype("datetime64[ms]").astype("datetime64[M]").astype("datetime64[ms]").astype(np.int64) if length is None else ms - ms % length


def _taken_in(bars: dict[str, list], level: str, rows: pd.DataFrame) -> None:
    """Add ticks (ms, us, seq, price, volume), by (us, seq), to the open bars of a level."""
    for start, own in rows.groupby(_starts(rows["ms"].to_numpy(), level)):
        ends = [[int(own[c].iloc[k]) for c in ("us", "seq")] + [float(own["price"].iloc[k])] for k in (0, -1)]
        volume = own["volume"].sum(min_count=1)
        new = [*ends, float(own["price"].max()), float(own["price"].min()), None if pd.isna(volume) else float(volume)]
        old = bars.get(f"{level} {start}")
        if old:
            parts = [x for x in (old[4], new[4]) if x is not None]
            new = [min(old[0], new[0]), max(old[1], new[1]), max(old[2], new[2]), min(old[3], new[3]), sum(parts) if parts else None]
        bars[f"{level} {start}"] = new


def candle_streams(ticks: DataFrame, levels: list[str] | None = None, late: str = "1 hour") -> DataFrame:
    """Candles of a stream of ticks (symbol, ts, seq, price, volume) at all levels at once, calendar months included.

    Spark keeps the open bars of each symbol as state. A bar is given once the watermark has passed its end, by a timer if no further tick of its symbol comes;
    ticks of bars that have been given are left out."""
    named = levels or [x[0] for x in LEVELS]

    def run(key, frames, state):
        bars = json.loads(state.get[0]) if state.exists else {}
        closed = state.getCurrentWatermarkMs()
        for rows in frames:
            us = rows["ts"].astype("datetime64[us]").astype("int64")
            rows = rows.assign(us=us, ms=us // 1000).sort_values(["us", "seq"], kind="stable")
            for level in named:
                ends = np.array([bar_end(x, level) for x in _starts(rows["ms"].to_numpy(), level).tolist()])
                own = rows[ends > closed]
                if len(own):
                    _taken_in(bars, level, own)
        ends = {name: bar_end(int(name.split()[1]), name.split()[0]) for name in bars}
        done = sorted(name for name, end in ends.items() if end <= closed)
        if done:
            found = [(key[0], name.split()[0], int(name.split()[1]), *((b := bars.pop(name))[0][2], b[2], b[3], b[1][2], b[4])) for name in done]
            yield pd.DataFrame(found, columns=[x.split()[0] for x in BARS.split(", ")]).astype({"volume": "float64"})
        if bars:
            state.update((json.dumps(bars),))
            state.setTimeoutTimestamp(max(closed + 1, min(ends[name] for name in bars)))
        else:
            state.remove()

    own = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy("symbol").applyInPandasWithState(run, BARS, HELD, "append", "EventTimeTimeout")
