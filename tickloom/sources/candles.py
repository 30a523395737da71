"""Reading and writing candle tables, JSON archives, exchange payloads and result files."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.quality import SERIES, last_candle, normalize

#: Column names and types of a candle table; all but the volume hold no nulls.
SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("level", T.StringType()), T.StructField("time", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
PRICES = ["open", "high", "low", "close"]


#: Levels whose tables are cut into months; those of others into years.
FINE = ["1m", "3m", "5m", "15m", "30m"]


def period() -> Column:
    """The part of its series' files that a bar belongs to."""
    day = F.timestamp_millis("time")
    return F.when(F.col("level").isin(FINE), F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy"))


class SchemaError(ValueError):
    """A table that isn't a candle table."""


def read_candles(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The table as SCHEMA; SchemaError for other columns or types, or nulls in a column but volume.

    where picks rows by symbol, level and period, the table's folders; only those are read and checked."""
    found = spark.read.parquet(path)
    want, have = {f.name: f.dataType for f in SCHEMA}, {f.name: f.dataType for f in found.schema if f.name != "period"}
    if want != have:
        raise SchemaError(f"expected {want}, found {have}")
    d = (found if where is None else found.where(where)).select(*SCHEMA.names)
    nulls = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in SCHEMA.names if c != "volume"]).first().asDict()
    if bad := [c for c, n in nulls.items() if n]:
        raise SchemaError(f"nulls in {bad}")
    return d


def write_candles(df: DataFrame, path: str) -> None:
    """Replace the periods of series that df has rows of in the table; others stay, and a failed write leaves the old ones."""
    own = df.select(*SCHEMA.names).withColumn("period", period())
    own.repartition(*SERIES, "period").sortWithinPartitions(*SERIES, "period", "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES, "period").parquet(path)


def read_json(spark: SparkSession, path: str, symbol: str, level: str) -> DataFrame:
    """An archive of {time, open, high, low, close} objects; malformed input fails."""
    schema = "time long, open double, high double, low double, close double"
    d = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return d.select(F.lit(symbol).alias("symbol"), F.lit(level).alias("level"), "time", *PRICES, F.lit(None).cast("double").alias("volume"), F.monotonically_increasing_id().alias("arrival"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at the path, as the file system says."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def is_unreadable(error: Exception) -> bool:
    """Whether an error says that files aren't a candle table: other columns, or no Parquet files. Errors of access or network aren't."""
    text = str(error)
    return isinstance(error, SchemaError) or any(x in text for x in ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "ChecksumException", "UNABLE_TO_INFER_SCHEMA"))


def migrate_json(spark: SparkSession, path: str, symbol: str, level: str, target: str) -> bool:
    """Convert an archive into the table, normalized; False where the table has the series already.

    A series of the table whose files aren't a candle table is rebuilt; any other error rises."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    own = f"{target.rstrip('/')}/symbol={escaped(symbol)}/level={escaped(level)}"
    if exists(spark, own):
        try:
            found = spark.read.parquet(own)
            missing = {f.name: f.dataType for f in SCHEMA if f.name not in SERIES}
            if {f.name: f.dataType for f in found.schema if f.name != "period"} != missing:
                raise SchemaError(f"expected {missing}")
            if found.limit(1).count():
                return False
        except Exception as error:
            if not is_unreadable(error):
                raise
    write_candles(normalize(read_json(spark, path, symbol, level), "arrival").drop("arrival"), target)
    return True


def migrate_archives(spark: SparkSession, archives: dict[tuple[str, str], str], target: str) -> dict[tuple[str, str], bool]:
    """migrate_json for the archive of each (symbol, level): which were converted."""
    return {(symbol, level): migrate_json(spark, path, symbol, level, target) for (symbol, level), path in archives.items()}


def parse_klines(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of payloads (symbol, level, payload): an array of arrays, the time first and then four prices as text.

    Other columns of raw come along, and ``place`` is a row's place in its payload. Bad rows are those with a missing or invalid field,
    payloads that are no such array, and symbols with ``SWAP``."""
    rest = [c for c in raw.columns if c not in ("symbol", "level", "payload")]
    rows = raw.select("symbol", "level", *rest, F.posexplode_outer(F.from_json("payload", "array<array<string>>")).alias("place", "k"))
    field = lambda i, kind: F.expr(f"try_cast(try_element_at(k, {i + 1}) as {kind})")
    parsed = rows.select("symbol", "level", *rest, "place", "k", field(0, "bigint").alias("time"), *[field(i + 1, "double").alias(c) for i, c in enumerate(PRICES)])
    ok = F.col("time").isNotNull() & ~F.col("symbol").contains("SWAP")
    for c in PRICES:
        ok = ok & F.col(c).isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return parsed.where(ok).select("symbol", "level", "time", *PRICES, *rest, "place"), parsed.where(~ok).select("symbol", "level", "place", "k")


def result_record(best: DataFrame, name: str, precision: str, strategy: str, text: Column, duration_ms: float) -> DataFrame:
    """Result rows as text, three decimals. The names of the columns are fixed values."""
    number = lambda c: F.format_string("%.3f", c)
    return best.select(
        F.lit(name).alias("Filename"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("Date"), F.lit(precision).alias("Precision"), F.lit(strategy).alias("Strategy"), text.alias("Params"),
        number(F.lit(float(duration_ms))).alias("DurationMs"), number("final_value").alias("portfolio_val"), number("max_dd").alias("max_dd"), number("sharpe").alias("sharpe_ratio"),
    )


def append_result(df: DataFrame, path: str) -> None:
    """Add rows to a folder of one CSV file with a header; fields with commas or quotes are quoted. Results are few: the file is written anew beside the old one, then takes its place."""
    spark, aside, before = df.sparkSession, f"{path.rstrip('/')}-new", f"{path.rstrip('/')}-before"
    where = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = where(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not exists(spark, path) and exists(spark, before):  # broken off between the two renames
        files.rename(where(before), where(path))
    if exists(spark, path):
        df = spark.read.option("header", True).option("escape", '"').schema(df.schema).csv(path).unionByName(df)
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(aside)
    if exists(spark, path):
        files.delete(where(before), True)
        files.rename(where(path), where(before))
    files.rename(where(aside), where(path))
    files.delete(where(before), True)


def time_ms(text: str) -> int:
    """A date (midnight UTC) or milliseconds."""
    return int(text) if text.isdigit() else int(datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=UTC).timestamp() * 1000)


def scan_range(df: DataFrame, start: str | int | None = None, end: str | int | None = None, inclusive: bool = False) -> DataFrame:
    """Bars from start to end; either may be open. The filter reaches the files."""
    if start is not None:
        df = df.where(F.col("time") >= time_ms(str(start)))
    if end is not None:
        df = df.where(F.col("time") <= time_ms(str(end)) - (0 if inclusive else 1))
    return df


def select_series(df: DataFrame, symbol: str, level: str) -> DataFrame:
    """time, open and close of one series; the symbol in any case, with a hyphen in it."""
    if "-" not in symbol:
        raise ValueError(f"no pair: {symbol}")
    return df.where((F.col("symbol") == symbol.upper()) & (F.col("level") == level)).select("time", "open", "close")


def last_time(df: DataFrame) -> DataFrame:
    """The last bar's time of each series; an error for an empty table."""
    if df.isEmpty():
        raise ValueError("no candles")
    return last_candle(df)
