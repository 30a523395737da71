"""Registered queries over the given tables and the SQL that checks them.

Candles come from the events (a symbol for each event type, hourly) and from the orders (a symbol
for each priority, daily). Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.pmax import pmax
from tickloom.functions.scan import ema, ema_grid
from tickloom.operators import backtest as bt
from tickloom.operators import build, exits, joins, quality
from tickloom.operators import trades as tr
from tickloom.sources import candles as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FEE, CAPITAL, HOUR = 0.0015, 1000.0, 3_600_000
FAST, SLOW = 5, 20


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.events_as_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build_candles(ticks(spark, sf_dir), "1h")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build_candles(build.orders_as_ticks(spark.read.parquet(f"{sf_dir}/orders.parquet")), "1d")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# SQL pieces

TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"


def candles_sql(level: str, start: str, source: str = "ticks", name: str = "candles") -> str:
    return f"""{name} AS (SELECT symbol, '{level}' AS level, {start} AS time, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, seq) AS close, sum(volume) AS volume FROM {source} GROUP BY 1, 2, 3)"""


EPOCH_HOUR = "CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT)"
HOURLY = f"{TICKS}, {candles_sql('1h', EPOCH_HOUR)}"
ORDER_TICKS = "ticks AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS seq, o_totalprice AS price, 1.0::DOUBLE AS volume FROM orders)"
DAILY = f"{ORDER_TICKS}, {candles_sql('1d', 'CAST(epoch_ms(date_trunc(\'day\', ts)) AS BIGINT)')}"
BARS = "bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS n FROM candles)"


def query(name: str, sql: str | None = None, places: int = 6):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), places)
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def on_hours(name: str, columns: list[str], fn, select: str, before: str = "", places: int = 6):
    """A query of columns that fn adds to the hourly candles, and SQL that selects them from ``bars`` (window w by symbol and time)."""
    exprs = ", ".join(f"round({x}, {places}) AS {c}" if not x.startswith("!") else f"{x[1:]} AS {c}" for c, x in zip(columns, select.split(" ;; "), strict=True))
    sql = f"WITH RECURSIVE {HOURLY}, {BARS}{', ' + before if before else ''} SELECT symbol, time, {exprs} FROM {'result' if before else 'bars'} WINDOW w AS (PARTITION BY symbol ORDER BY time)"
    QUERIES[name] = lambda spark, sf_dir: rounded(fn(hourly(spark, sf_dir)).select("symbol", "time", *columns), places)
    ORACLE_SQL[name] = sql


def full(fn: str, x: str, n: int, upto: int = 0) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1 - upto} PRECEDING AND {f'{-upto} PRECEDING' if upto else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {w} = {n} THEN {fn}({x}) {w} END"


# Sources and preparation


@query("candles_hourly", f"WITH {HOURLY} SELECT symbol, level, time, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(volume,6) AS volume FROM candles")
def candles_hourly(spark, sf_dir):
    """D7."""
    return hourly(spark, sf_dir)


@query("candles_daily", f"WITH {DAILY} SELECT symbol, level, time, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(volume,6) AS volume FROM candles")
def candles_daily(spark, sf_dir):
    return daily(spark, sf_dir)


def _rollup_sql(level: str, start: str) -> str:
    return f"""WITH {HOURLY} SELECT symbol, '{level}' AS level, CAST({start} AS BIGINT) AS time, first(open ORDER BY time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY time) AS close, sum(volume) AS volume
        FROM candles GROUP BY 1, 2, 3"""


for _level, _start in (("4h", "time - time % 14400000"), ("3d", "time - time % 259200000"), ("1w", "epoch_ms(date_trunc('week', make_timestamp(time * 1000)))"), ("1M", "epoch_ms(date_trunc('month', make_timestamp(time * 1000)))")):
    query(f"rollup_{_level if _level != '1M' else 'month'}", _rollup_sql(_level, _start))(lambda spark, sf_dir, level=_level: build.rollup(hourly(spark, sf_dir), level))


@query(
    "level_usage",
    f"""WITH {TICKS}, c(token, name, ppy) AS (VALUES ('1h','1h',8760), ('1d','1d',365), ('3d','3d',121), ('1w','1w',52), ('1mo','1M',12), ('1m','1m',525600))
    SELECT c.token, c.name AS level, c.ppy::INT AS periods_per_year, count(*)::BIGINT AS ticks FROM ticks, c GROUP BY 1, 2, 3""",
)
def level_usage(spark, sf_dir):
    """D6: tokens of levels, their year's periods, joined to the ticks that they would bar."""
    tokens = spark.createDataFrame([(t,) for t in ("1h", "1d", "3d", "1w", "1mo", "1m", "xyz", "99h", "")], "token string")
    named = tokens.withColumn("level", build.parse_level(F.col("token"))).join(F.broadcast(build.levels(spark)), "level")
    n = ticks(spark, sf_dir).agg(F.count("*").alias("ticks"))
    return named.crossJoin(n).select("token", "level", "periods_per_year", "ticks")


@query("last_candle", f"WITH {HOURLY} SELECT symbol, level, max(time) AS last_time FROM candles GROUP BY 1, 2")
def last_candle(spark, sf_dir):
    """S6."""
    return src.last_time(hourly(spark, sf_dir))


@query("scan_range", f"WITH {HOURLY} SELECT symbol, time, round(close,6) AS close FROM candles WHERE time >= epoch_ms(TIMESTAMP '2024-01-05') AND time < epoch_ms(TIMESTAMP '2024-01-12')")
def scan_range(spark, sf_dir):
    """S7."""
    return src.scan_range(hourly(spark, sf_dir), "2024-01-05", "2024-01-12").select("symbol", "time", "close")


@query("select_series", f"WITH {DAILY} SELECT time, round(open,6) AS open, round(close,6) AS close FROM candles WHERE symbol = '1-URGENT'")
def select_series(spark, sf_dir):
    """S8."""
    return src.select_series(daily(spark, sf_dir), "1-urgent", "1d")


def arrivals(spark, sf_dir):
    """Every candle of the hours in the order of its closing tick's id, the first and each seventh twice."""
    d = hourly(spark, sf_dir).withColumn("arrival", F.col("time") / HOUR % 97 * 1000 + F.col("time") / HOUR % 1000)
    return d.unionByName(d.where(F.col("time") / HOUR % 7 == 0).withColumn("arrival", F.col("arrival") + 0.5).withColumn("close", F.col("close") + 1))


ARRIVALS = f"""{HOURLY}, one AS (SELECT *, time / 3600000 % 97 * 1000 + time / 3600000 % 1000 AS arrival FROM candles),
    raw AS (SELECT symbol, level, time, close, CAST(arrival AS DOUBLE) AS arrival FROM one UNION ALL SELECT symbol, level, time, close + 1, arrival + 0.5 FROM one WHERE time / 3600000 % 7 = 0)"""


@query("normalize", f"WITH {ARRIVALS} SELECT symbol, time, round(arg_min(close, arrival),6) AS close FROM raw GROUP BY 1, 2")
def normalize(spark, sf_dir):
    """D1."""
    return quality.normalize(arrivals(spark, sf_dir), "arrival").select("symbol", "time", "close")


@query(
    "normalize_report",
    f"""WITH {ARRIVALS}, l AS (SELECT *, lag(time) OVER (PARTITION BY symbol, level ORDER BY arrival) AS p FROM raw)
    SELECT symbol, level, bool_or(coalesce(time < p, false)) AS was_unsorted, count(*) - count(DISTINCT time) AS removed_duplicates,
    bool_or(coalesce(time < p, false)) OR count(*) > count(DISTINCT time) AS changed FROM l GROUP BY 1, 2""",
)
def normalize_report(spark, sf_dir):
    """D2."""
    return quality.normalize_report(arrivals(spark, sf_dir), "arrival")


@query("check_increasing", f"WITH {ARRIVALS}, l AS (SELECT *, lag(time) OVER (PARTITION BY symbol, level ORDER BY arrival) AS previous FROM raw) SELECT symbol, level, previous, time FROM l WHERE time <= previous")
def check_increasing(spark, sf_dir):
    """D3."""
    return quality.check_increasing(arrivals(spark, sf_dir), "arrival")


@query(
    "interval_check",
    f"""WITH {HOURLY}, g AS (SELECT symbol, level, time, time - lag(time) OVER (PARTITION BY symbol ORDER BY time) AS gap FROM candles), e AS (SELECT symbol, arg_min(gap, time) AS expected FROM g WHERE gap IS NOT NULL GROUP BY 1)
    SELECT g.symbol, level, bool_and(gap = expected) AS constant, max(greatest(gap, expected)) AS max_gap FROM g JOIN e USING (symbol) WHERE gap IS NOT NULL GROUP BY 1, 2""",
)
def interval_check(spark, sf_dir):
    """D4."""
    return quality.interval_check(hourly(spark, sf_dir))


@query("merge_candles", f"WITH {HOURLY} SELECT symbol, time, round(CASE WHEN time / 3600000 % 3 = 0 THEN close + 1 ELSE close END,6) AS close FROM candles")
def merge_candles(spark, sf_dir):
    """D5: a third of the bars is there, with other prices; all arrive."""
    d = hourly(spark, sf_dir)
    there = d.where(F.col("time") / HOUR % 3 == 0).withColumn("close", F.col("close") + 1)
    return quality.merge_candles(there, d).select("symbol", "time", "close")


@query("boundaries", f"WITH {DAILY} SELECT symbol, level, strftime(make_timestamp(min(time) * 1000), '%Y-%m-%d') AS first_date, strftime(make_timestamp(max(time) * 1000), '%Y-%m-%d') AS last_date FROM candles GROUP BY 1, 2")
def boundaries(spark, sf_dir):
    """D11."""
    return quality.boundaries(daily(spark, sf_dir))


NOW = 1706745600000


@query(
    "freshness_plan",
    f"""WITH {HOURLY}, l AS (SELECT symbol, max(time) AS last_time FROM candles GROUP BY 1), u AS (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'missing')
    SELECT u.symbol, '1h' AS level, last_time, greatest(0, {NOW} - last_time) AS age_ms, coalesce(greatest(0, {NOW} - last_time) < 172800000, false) AS fresh,
    CASE WHEN coalesce(greatest(0, {NOW} - last_time) < 172800000, false) THEN NULL WHEN last_time IS NULL THEN 5 ELSE last_time + 1 END AS fetch_from FROM u LEFT JOIN l USING (symbol)""",
)
def freshness_plan(spark, sf_dir):
    """D8."""
    d = hourly(spark, sf_dir)
    wanted = d.select("symbol").distinct().unionAll(spark.createDataFrame([("missing",)], "symbol string")).withColumn("level", F.lit("1h"))
    return quality.freshness_plan(d, wanted, NOW, 5)


@query("universe", f"WITH {DAILY} SELECT symbol, min(time) AS listed FROM candles WHERE symbol IN ('1-URGENT', '2-HIGH', '5-LOW') AND symbol <> '5-LOW' GROUP BY 1")
def universe(spark, sf_dir):
    """D9."""
    return quality.universe(daily(spark, sf_dir), ["1-URGENT", "2-HIGH", "5-LOW"], ["5-LOW"], 30, NOW)


@query("preview_tail", f"WITH {HOURLY} SELECT symbol, time, round(close,6) AS close FROM candles WHERE time >= 0 AND time < {NOW} ORDER BY time DESC, symbol LIMIT 20")
def preview_tail(spark, sf_dir):
    """D10."""
    return quality.preview(hourly(spark, sf_dir), 0, NOW, 20, last=True).select("symbol", "time", "close")


@query(
    "parse_klines",
    f"""WITH {HOURLY} SELECT symbol, CASE WHEN symbol = 'click' OR time / 3600000 % 11 = 0 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n,
    round(sum(CASE WHEN symbol = 'click' OR time / 3600000 % 11 = 0 THEN NULL ELSE close END),4) AS closes FROM candles GROUP BY 1, 2""",
    places=4,
)
def parse_klines(spark, sf_dir):
    """S4: the hours as payloads of one bar each; every eleventh has a bad field, and one symbol is refused."""
    text = lambda c: F.col(c).cast("string")
    bad = F.when(F.col("time") / HOUR % 11 == 0, "x").otherwise(text("high"))
    k = F.array(F.array(text("time"), text("open"), bad, text("low"), text("close")))
    raw = hourly(spark, sf_dir).select(F.when(F.col("symbol") == "click", "click-SWAP").otherwise(F.col("symbol")).alias("symbol"), "level", F.to_json(k).alias("payload"))
    good, wrong = src.parse_klines(raw)
    both = good.select("symbol", F.lit("good").alias("kind"), "close").unionByName(wrong.select("symbol", F.lit("bad").alias("kind"), F.lit(None).cast("double").alias("close")))
    return both.groupBy(F.regexp_replace("symbol", "-SWAP$", "").alias("symbol"), "kind").agg(F.count("*").alias("n"), F.sum("close").alias("closes"))


# Averages


def ema_sql(periods: str, name: str = "e", source: str = "bars", x: str = "close") -> str:
    return f"""{name} AS (SELECT symbol, n, time, p.period, {x} AS s FROM {source}, (SELECT unnest({periods}) AS period) p WHERE n = 1
        UNION ALL SELECT b.symbol, b.n, b.time, e.period, b.{x} * 2 / (e.period + 1) + e.s * (1 - 2.0::DOUBLE / (e.period + 1)) FROM {name} e JOIN {source} b ON b.symbol = e.symbol AND b.n = e.n + 1)"""


@query("ema", f"WITH RECURSIVE {HOURLY}, {BARS}, {ema_sql('[12]')} SELECT symbol, time, CASE WHEN n >= 12 THEN round(s, 6) END AS ema FROM e")
def ema_query(spark, sf_dir):
    """E1."""
    return ema(hourly(spark, sf_dir), "close", 12, "ema", ["symbol", "level"]).select("symbol", "time", "ema")


@query("ema_grid", f"WITH RECURSIVE {HOURLY}, {BARS}, {ema_sql('range(1, 9)')} SELECT symbol, time, period::INT AS period, CASE WHEN n >= period THEN round(s, 6) END AS ema FROM e")
def ema_grid_query(spark, sf_dir):
    """E2."""
    return ema_grid(hourly(spark, sf_dir), 1, 8, ["symbol", "level"]).select("symbol", "time", "period", "ema")


# Indicators by windows

_TP = "(high + low + close) / 3"
_TR = "CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END"
on_hours("sma", ["sma_9", "sma_30"], lambda d: ind.sma(d, (9, 30)), f"{full('avg', 'close', 9)} ;; {full('avg', 'close', 30)}")
on_hours("highs_lows", ["hh_20", "ll_20", "low_5", "mid_20"], ind.highs_lows, f"{full('max', 'high', 20)} ;; {full('min', 'low', 20)} ;; {full('min', 'low', 5, -1)} ;; ({full('max', 'high', 20)} + {full('min', 'low', 20)}) / 2")
on_hours("volume_means", ["volume_mean_4", "volume_mean_12", "volume_mean_24"], ind.volume_means, " ;; ".join(full("avg", "volume", n, -1) for n in (4, 12, 24)))
on_hours("vwma", ["vwma_20"], lambda d: ind.vwma(d, 20), f"({full('avg', '(close * volume)', 20)}) / nullif({full('avg', 'volume', 20)}, 0)")
on_hours("roc", ["roc_9", "rocr_9", "mom_9"], lambda d: ind.roc(d, 9), "(close / lag(close, 9) OVER w - 1) * 100 ;; close / lag(close, 9) OVER w ;; close - lag(close, 9) OVER w")
on_hours("range_change", ["hl_change_5"], lambda d: ind.range_change(d, "HL", 5), f"({full('max', 'high', 5)} - {full('min', 'low', 5)}) / ({full('min', 'low', 5)})")
on_hours("open_close_range", ["oc_change_8"], lambda d: ind.range_change(d, "OC", 8), f"({full('max', 'open', 8)} - {full('min', 'close', 8)}) / nullif({full('min', 'close', 8)}, 0)")
on_hours("williams_r", ["r_14", "r_96"], lambda d: ind.williams_r(d, 14, 96), " ;; ".join(f"-100 * ({full('max', 'high', n)} - close) / nullif({full('max', 'high', n)} - {full('min', 'low', n)}, 0)" for n in (14, 96)))
_FLOW = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"
_W20 = "OVER (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING)"
on_hours("money_flow", ["cmf"], ind.money_flow, f"sum({_FLOW}) {_W20} / nullif(sum(volume) {_W20}, 0)")
on_hours("bollinger", ["bb2_mid", "bb2_low", "bb2_up"], lambda d: ind.bollinger(d, 20, 2, "bb2"), f"{full('avg', _TP, 20)} ;; {full('avg', _TP, 20)} - 2 * {full('stddev_samp', _TP, 20)} ;; {full('avg', _TP, 20)} + 2 * {full('stddev_samp', _TP, 20)}")
on_hours("fast_stochastic", ["fastk"], ind.fast_stochastic, f"(close - {full('min', 'low', 5)}) / nullif({full('max', 'high', 5)} - {full('min', 'low', 5)}, 0) * 100")
on_hours("true_range", ["trange"], lambda d: d.withColumn("trange", ind.true_range()), _TR)
on_hours("keltner", ["kc_low_20", "kc_up_20"], lambda d: ind.keltner(d, 20, 2), f"{full('avg', 'close', 20)} - 2 * {full('avg', 'tr', 20)} ;; {full('avg', 'close', 20)} + 2 * {full('avg', 'tr', 20)}", f"result AS (SELECT *, {_TR} AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time))")
on_hours("correlation_trend", ["cti_20"], lambda d: ind.correlation_trend(d, 20), "CASE WHEN n >= 20 THEN corr(close, n) OVER (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING) END")
on_hours("close_delta", ["closedelta"], lambda d: ind.close_deltas(d), "abs(close - lag(close) OVER w)")
_HA = """h AS (SELECT symbol, n, (open + close) / 2 AS ho, (open + high + low + close) / 4 AS hc FROM bars WHERE n = 1
    UNION ALL SELECT b.symbol, b.n, (h.ho + h.hc) / 2, (b.open + b.high + b.low + b.close) / 4 FROM h JOIN bars b ON b.symbol = h.symbol AND b.n = h.n + 1),
    result AS (SELECT bars.*, ho, hc FROM bars JOIN h USING (symbol, n))"""
on_hours("heikin_ashi", ["ha_open", "ha_close", "ha_high", "ha_low"], ind.heikin_ashi, "ho ;; hc ;; greatest(high, ho, hc) ;; least(low, ho, hc)", _HA)


def _wilder_sql(x: str, n: int, name: str, first: int) -> str:
    """Wilder smoothing of x in bars2, whose first value is at bar ``first``."""
    return f"""{name} AS (SELECT symbol, {first + n - 1} AS n, avg({x}) AS s FROM bars2 WHERE n BETWEEN {first} AND {first + n - 1} GROUP BY 1 HAVING count(*) = {n}
        UNION ALL SELECT b.symbol, b.n, {name}.s + (b.{x} - {name}.s) / {n} FROM {name} JOIN bars2 b ON b.symbol = {name}.symbol AND b.n = {name}.n + 1)"""


_CHANGE = "bars2 AS (SELECT *, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS dn, {tr} AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time))".format(tr=_TR)
_RSI = f"{_CHANGE}, {_wilder_sql('up', 14, 'wu', 2)}, {_wilder_sql('dn', 14, 'wd', 2)}, result AS (SELECT bars.*, CASE WHEN wu.s + wd.s = 0 THEN 50 ELSE 100 * wu.s / (wu.s + wd.s) END AS r FROM bars LEFT JOIN wu USING (symbol, n) LEFT JOIN wd USING (symbol, n))"
on_hours("rsi", ["rsi_14"], lambda d: ind.rsi(d, 14), "r", _RSI)
on_hours("fisher", ["fisher"], ind.fisher, "(exp(0.2 * (r - 50)) - 1) / (exp(0.2 * (r - 50)) + 1)", _RSI)
on_hours("atr", ["atr_10"], lambda d: ind.atr(d, 10), "s", f"{_CHANGE}, {_wilder_sql('tr', 10, 'wt', 2)}, result AS (SELECT bars.*, wt.s FROM bars LEFT JOIN wt USING (symbol, n))")

# Backtests

_SIG = f"""{HOURLY}, {BARS}, {ema_sql(f'[{FAST}, {SLOW}]')},
    s AS (SELECT b.*, CASE WHEN b.n >= {SLOW} THEN CASE WHEN f.s > l.s THEN 1 WHEN f.s < l.s THEN 0 END END AS sig FROM bars b JOIN e f ON f.symbol = b.symbol AND f.n = b.n AND f.period = {FAST} JOIN e l ON l.symbol = b.symbol AND l.n = b.n AND l.period = {SLOW}),
    k AS (SELECT *, last_value(sig IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY n) AS kept FROM s),
    h AS (SELECT *, coalesce(lag(kept) OVER (PARTITION BY symbol ORDER BY n), 0) AS held FROM k),
    g AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY n), 0) AS was, lag(close) OVER (PARTITION BY symbol ORDER BY n) AS pc FROM h),
    f AS (SELECT *, CASE WHEN held = 1 AND was = 0 THEN (1 - {FEE}) * close / open WHEN held = 0 AND was = 1 THEN (1 - {FEE}) * open / pc WHEN held = 1 THEN close / pc ELSE 1 END AS factor FROM g),
    v AS (SELECT *, {CAPITAL} * exp(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY n)) AS value FROM f),
    q AS (SELECT *, max(value) OVER (PARTITION BY symbol ORDER BY n) AS peak, CASE WHEN n > 1 THEN factor - 1 END AS ret FROM v)"""


def one_pair() -> bt.DoubleEma:
    return bt.DoubleEma(pairs=[(FAST, SLOW)])


def in_logs(scores: DataFrame) -> DataFrame:
    """The given prices jump so much that values reach any size: they are compared as logarithms, that of 0 being minus infinity."""
    return scores.withColumn("log_final", F.when(F.col("final_value") == 0, F.lit(float("-inf"))).otherwise(F.log("final_value"))).drop("final_value")


def scored(candles: DataFrame, strategy: bt.Strategy, level: str = "1h") -> DataFrame:
    """Scores as the SQL has them: returns count after a sale at 0 too."""
    return bt.backtest(candles, strategy, level, FEE, CAPITAL, after_loss=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(in_logs(scored(hourly(spark, sf_dir), one_pair())), 4)


QUERIES["backtest"] = flagship
ORACLE_SQL["backtest"] = f"""WITH RECURSIVE {_SIG} SELECT symbol, '1h' AS level, {FAST} AS fast, {SLOW} AS slow, round(ln(arg_max(value, n)), 4) AS log_final, round(max((peak - value) / peak * 100), 4) AS max_dd,
    round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(8760) ELSE 0 END, 4) AS sharpe, count(*) AS bars FROM q GROUP BY 1"""


@query("positions", f"WITH RECURSIVE {_SIG} SELECT symbol, time, held, round(factor, 6) AS factor, round(ln(value), 4) AS log_value FROM q")
def positions(spark, sf_dir):
    """R1, B1-B3."""
    return bt.runs(hourly(spark, sf_dir), one_pair(), FEE, CAPITAL).select("symbol", "time", "held", "factor", F.round(F.log("value"), 4).alias("log_value"))


_TRADES = f"""{_SIG}, t AS (SELECT *, sum(CASE WHEN held = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY n) AS tid, coalesce(lag(value) OVER (PARTITION BY symbol ORDER BY n), {CAPITAL}) AS before FROM q),
    trades AS (SELECT symbol, CAST(tid AS BIGINT) AS trade_id, max(CASE WHEN held = 1 AND was = 0 THEN time END) AS open_time, max(CASE WHEN held = 0 AND was = 1 THEN time END) AS close_time, max(CASE WHEN held = 1 AND was = 0 THEN open END) AS open_rate,
    max(CASE WHEN held = 0 AND was = 1 THEN open END) AS close_rate, max(CASE WHEN held = 1 AND was = 0 THEN before END) AS stake FROM t WHERE held <> was GROUP BY 1, 2),
    closed AS (SELECT *, {(1 - FEE) * (1 - FEE)!r} * close_rate / open_rate - 1 AS profit_ratio, 100 * ({(1 - FEE) * (1 - FEE)!r} * close_rate / open_rate - 1) AS profit_abs FROM trades WHERE close_time IS NOT NULL)"""


def closed(spark, sf_dir):
    return closed_of(hourly(spark, sf_dir))


def closed_of(candles: DataFrame) -> DataFrame:
    """The trades of one pair of averages, each with the same stake."""
    keys = [*bt.SERIES, *one_pair().params]
    return bt.trades(bt.runs(candles, one_pair(), FEE, CAPITAL), keys, FEE, CAPITAL).drop(*keys[1:]).withColumn("profit_abs", 100 * F.col("profit_ratio"))


def with_trades(name: str, sql: str, places: int = 4):
    return query(name, f"WITH RECURSIVE {_TRADES} {sql}", places)


@with_trades("trades", "SELECT symbol, trade_id, open_time, close_time, round(open_rate,4) AS open_rate, round(close_rate,4) AS close_rate, round(profit_ratio,4) AS profit_ratio, 'signal' AS exit_reason FROM closed")
def trades(spark, sf_dir):
    """B9."""
    return closed(spark, sf_dir).drop("profit_abs")


_DAILY = """, spans AS (SELECT symbol, CAST(make_timestamp(min(time) * 1000) AS DATE) AS a, CAST(make_timestamp(max(time) * 1000) AS DATE) AS b FROM candles GROUP BY 1),
    days AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT min(a) AS a, max(b) AS b FROM spans)),
    dp AS (SELECT day, coalesce(sum(profit_ratio - 0.0005), 0) AS profit FROM days LEFT JOIN closed ON CAST(make_timestamp(close_time * 1000) AS DATE) = day GROUP BY 1)"""


def by_day(spark, sf_dir):
    return tr.daily_profit(closed(spark, sf_dir), tr.calendar(hourly(spark, sf_dir)))


query("daily_profit", f"WITH RECURSIVE {_TRADES}{_DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, round(profit,6) AS profit FROM dp")(lambda spark, sf_dir: by_day(spark, sf_dir).withColumn("day", F.col("day").cast("string")))
query("daily_sharpe", f"WITH RECURSIVE {_TRADES}{_DAILY} SELECT round(CASE WHEN stddev_samp(profit) > 0 THEN avg(profit) / stddev_samp(profit) * sqrt(365) ELSE -20 END,6) AS sharpe FROM dp")(lambda spark, sf_dir: tr.daily_sharpe(by_day(spark, sf_dir)))
query("daily_equity", f"WITH RECURSIVE {_TRADES}{_DAILY} SELECT strftime(day, '%Y-%m-%d') AS day, round(coalesce(sum(profit) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0),6) AS equity FROM dp")(lambda spark, sf_dir: tr.daily_equity(by_day(spark, sf_dir)).withColumn("day", F.col("day").cast("string")))
with_trades("win_stats", "SELECT symbol, count(*) AS trades, count(*) FILTER (profit_ratio > 0) AS wins, round(sum(profit_abs),4) AS profit, round(count(*) FILTER (profit_ratio > 0)::DOUBLE / count(*),4) AS win_rate FROM closed GROUP BY 1")(lambda spark, sf_dir: tr.win_stats(closed(spark, sf_dir), ["symbol"]))
_CURVE = ", c AS (SELECT *, sum(profit_abs) OVER (PARTITION BY symbol ORDER BY close_time, trade_id) AS cumulated FROM closed), u AS (SELECT *, greatest(max(cumulated) OVER (PARTITION BY symbol ORDER BY close_time, trade_id), 0) AS high FROM c)"
query("underwater", f"WITH RECURSIVE {_TRADES}{_CURVE} SELECT symbol, trade_id, close_time, round(cumulated,4) AS cumulated, round(high,4) AS high, round(cumulated - high,4) AS drawdown, round((high - cumulated) / (1000 + high),4) AS drawdown_share FROM u", 4)(
    lambda spark, sf_dir: tr.underwater(closed(spark, sf_dir), CAPITAL, ["symbol"]).drop("high_at")
)
with_trades("exit_counts", "SELECT symbol, 'signal' AS exit_reason, count(*) AS n FROM closed GROUP BY 1")(lambda spark, sf_dir: tr.exit_counts(closed(spark, sf_dir)))
with_trades("profit_hist", "SELECT CAST(floor(profit_ratio / 0.01) AS BIGINT) AS bin, count(*) AS n FROM closed GROUP BY 1")(lambda spark, sf_dir: tr.profit_hist(closed(spark, sf_dir)))
with_trades("pair_results", "SELECT symbol, count(*) AS trades, round(avg(profit_ratio),4) AS mean_profit, round(sum(profit_abs),4) AS profit FROM closed GROUP BY 1")(lambda spark, sf_dir: tr.pair_results(closed(spark, sf_dir)))
with_trades("parallelism", ", x AS (SELECT DISTINCT time FROM candles) SELECT x.time, count(closed.trade_id) AS open_trades FROM x LEFT JOIN closed ON open_time <= x.time AND close_time > x.time GROUP BY 1")(
    lambda spark, sf_dir: tr.parallelism(closed(spark, sf_dir), hourly(spark, sf_dir))
)
query("market_change", f"WITH {HOURLY}, a AS (SELECT symbol, arg_min(close, time) AS f, arg_max(close, time) AS l FROM candles GROUP BY 1) SELECT round(avg(l / f - 1),6) AS market_change FROM a")(lambda spark, sf_dir: tr.market_change(hourly(spark, sf_dir)))

# Sweeps

GRID = bt.DoubleEma(3, 4, 12)
_SWEEP = f"""{HOURLY}, {BARS}, {ema_sql('range(3, 13)')}, p AS (SELECT f.range AS fast, l.range AS slow FROM range(3, 13) f, range(4, 13) l WHERE l.range > f.range),
    s AS (SELECT b.*, fast, slow, CASE WHEN b.n >= slow THEN CASE WHEN f.s > l.s THEN 1 WHEN f.s < l.s THEN 0 END END AS sig FROM bars b, p JOIN e f ON f.period = p.fast JOIN e l ON l.period = p.slow AND l.symbol = f.symbol AND l.n = f.n WHERE f.symbol = b.symbol AND f.n = b.n),
    k AS (SELECT *, last_value(sig IGNORE NULLS) OVER (PARTITION BY symbol, fast, slow ORDER BY n) AS kept FROM s),
    h AS (SELECT *, coalesce(lag(kept) OVER (PARTITION BY symbol, fast, slow ORDER BY n), 0) AS held FROM k),
    g AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY symbol, fast, slow ORDER BY n), 0) AS was, lag(close) OVER (PARTITION BY symbol, fast, slow ORDER BY n) AS pc FROM h),
    f2 AS (SELECT *, CASE WHEN held = 1 AND was = 0 THEN (1 - {FEE}) * close / open WHEN held = 0 AND was = 1 THEN (1 - {FEE}) * open / pc WHEN held = 1 THEN close / pc ELSE 1 END AS factor FROM g),
    v AS (SELECT *, {CAPITAL} * exp(sum(ln(factor)) OVER (PARTITION BY symbol, fast, slow ORDER BY n)) AS value FROM f2),
    q AS (SELECT *, max(value) OVER (PARTITION BY symbol, fast, slow ORDER BY n) AS peak, CASE WHEN n > 1 THEN factor - 1 END AS ret FROM v),
    scores AS (SELECT symbol, '1h' AS level, fast::INT AS fast, slow::INT AS slow, arg_max(value, n) AS final_value, max((peak - value) / peak * 100) AS max_dd, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(8760) ELSE 0 END AS sharpe, count(*) AS bars FROM q GROUP BY 1, 2, 3, 4)"""
_SCORES = "symbol, level, fast, slow, round(ln(final_value),4) AS log_final, round(max_dd,4) AS max_dd, round(sharpe,4) AS sharpe, bars"


def scores(spark, sf_dir):
    return scored(hourly(spark, sf_dir), GRID)


@query("sweep", f"WITH RECURSIVE {_SWEEP} SELECT {_SCORES} FROM scores", 4)
def sweep(spark, sf_dir):
    """P1, P3, P9, J2, J3, B8."""
    return in_logs(scores(spark, sf_dir))


@query("sweep_top3", f"WITH RECURSIVE {_SWEEP}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, final_value DESC, fast, slow) AS rank FROM scores) SELECT {_SCORES}, rank::INT AS rank, 'fast=' || fast || ',slow=' || slow AS params FROM r WHERE rank <= 3", 4)
def sweep_top3(spark, sf_dir):
    """P4-P6."""
    return in_logs(bt.rank(scores(spark, sf_dir), GRID.params, 3)).withColumn("params", GRID.text())


@query("sweep_single_best", places=4)
def sweep_single_best(spark, sf_dir):
    """P2, R2: price against one average, the best of each series."""
    strategy = bt.SingleEma(5, 24)
    return in_logs(bt.rank(scored(hourly(spark, sf_dir), strategy), strategy.params, 1))


# Joins


@query(
    "asof_merge",
    f"WITH {HOURLY}, c AS (SELECT symbol, time - time % 14400000 AS t, last(close ORDER BY time) AS close FROM candles GROUP BY 1, 2) SELECT b.symbol, b.time, round(b.close,6) AS close, round(c.close,6) AS close_4h FROM candles b ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.time + 3600000 >= c.t + 14400000",
)
def asof_merge(spark, sf_dir):
    """J1."""
    d = hourly(spark, sf_dir)
    return joins.asof_merge(d, build.rollup(d, "4h"), ["close"], "_4h", HOUR, 4 * HOUR).select("symbol", "time", "close", "close_4h")


@with_trades("alive_bars", "SELECT c.symbol, trade_id, count(*) AS bars, round(max(b.close),4) AS highest FROM closed c JOIN candles b ON b.symbol = c.symbol AND b.time BETWEEN open_time AND close_time GROUP BY 1, 2")
def alive_bars(spark, sf_dir):
    """J4."""
    found = joins.alive_bars(closed(spark, sf_dir), hourly(spark, sf_dir).select("symbol", "time", "close"), 24 * HOUR)
    return found.groupBy("symbol", "trade_id").agg(F.count("*").alias("bars"), F.max("close").alias("highest"))


# Exits


def first_hit(d: DataFrame, trades_df: DataFrame) -> DataFrame:
    return trades_df.select("symbol", "trade_id").join(d, ["symbol", "trade_id"], "left")


@with_trades(
    "trailing_stop",
    """, b AS (SELECT c.symbol, trade_id, b.time, b.low, greatest(open_rate * (1 - 0.99), max(b.close * (1 - CASE WHEN b.close / open_rate - 1 > 0.2 THEN 0.05 WHEN b.close / open_rate - 1 > 0.1 THEN 0.03 WHEN b.close / open_rate - 1 > 0.06 THEN 0.02 WHEN b.close / open_rate - 1 > 0.03 THEN 0.015 END))
        OVER (PARTITION BY c.symbol, trade_id ORDER BY b.time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS stop FROM closed c JOIN candles b ON b.symbol = c.symbol AND b.time BETWEEN open_time AND close_time)
    SELECT symbol, trade_id, min(time) AS stop_time, round(arg_min(stop, time),4) AS stop_rate FROM b WHERE low <= stop GROUP BY 1, 2""",
)
def trailing_stop(spark, sf_dir):
    """R8."""
    return exits.trailing_stop(closed(spark, sf_dir), hourly(spark, sf_dir))


@with_trades(
    "take_profit",
    """, b AS (SELECT c.symbol, trade_id, b.time, b.close / open_rate - 1 AS p, CASE WHEN b.time - open_time >= 292 * 60000 THEN 0.005 WHEN b.time - open_time >= 81 * 60000 THEN 0.038 ELSE 0.205 END AS wanted
        FROM closed c JOIN candles b ON b.symbol = c.symbol AND b.time BETWEEN open_time AND close_time)
    SELECT symbol, trade_id, min(time) AS take_time, round(arg_min(p, time),4) AS profit FROM b WHERE p >= wanted GROUP BY 1, 2""",
)
def take_profit(spark, sf_dir):
    """R9."""
    return exits.take_profit(closed(spark, sf_dir), hourly(spark, sf_dir))


@query(
    "slippage_guard",
    f"""WITH {HOURLY}, o AS (SELECT event_id AS order_id, event_type AS symbol, CAST(epoch_ms(ts) AS BIGINT) - 7200000 AS time, value AS rate FROM events)
    SELECT order_id, o.symbol, coalesce(rate <= c.close OR (rate / c.close - 1) * 100 < 0.983, false) AS accepted FROM o ASOF LEFT JOIN candles c ON o.symbol = c.symbol AND o.time >= c.time""",
)
def slippage_guard(spark, sf_dir):
    """R10: every event as an order at its price, two hours earlier."""
    orders = ticks(spark, sf_dir).select(F.col("seq").alias("order_id"), "symbol", (F.unix_millis(F.col("ts").cast("timestamp")) - 2 * HOUR).alias("time"), F.col("price").alias("rate"))
    return exits.slippage_guard(orders, hourly(spark, sf_dir)).select("order_id", "symbol", "accepted")


on_hours("exit_flag", ["exit_long"], exits.exit_flag, "!CASE WHEN volume > 0 THEN 0 END")

_PMAX = f"""{_CHANGE}, {_wilder_sql('tr', 10, 'wt', 2)}, bars3 AS (SELECT *, (high + low + close + open) / 4 AS x FROM bars), {ema_sql('[9]', 'e', 'bars3', 'x')},
    m AS (SELECT b.symbol, b.n, CASE WHEN b.n >= 9 THEN e.s END AS ma, 2.7 * wt.s AS wide FROM bars b JOIN e USING (symbol, n) LEFT JOIN wt USING (symbol, n)),
    l AS (SELECT symbol, n, ma, 0::DOUBLE AS top, 0::DOUBLE AS bottom, true AS upper FROM m WHERE n = 10 UNION ALL
        SELECT symbol, n, ma, t, b, CASE WHEN upper THEN ma <= t ELSE NOT ma >= b END FROM (
            SELECT m.symbol, m.n, m.ma, l.upper, CASE WHEN m.ma + m.wide < l.top OR l.ma > l.top THEN m.ma + m.wide ELSE l.top END AS t, CASE WHEN m.ma - m.wide > l.bottom OR l.ma < l.bottom THEN m.ma - m.wide ELSE l.bottom END AS b
            FROM l JOIN m ON m.symbol = l.symbol AND m.n = l.n + 1)),
    result AS (SELECT bars.*, CASE WHEN bars.n <= 10 THEN 0 WHEN upper THEN top ELSE bottom END AS pm, l.ma FROM bars LEFT JOIN l USING (symbol, n))"""
on_hours("pmax", ["pm", "pmx"], pmax, "pm ;; !CASE WHEN pm > 0 THEN CASE WHEN ma < pm THEN 'down' ELSE 'up' END END", _PMAX)

# Indicators over columns made on the way

_BB = "result AS (SELECT *, {m} AS m, {s} AS sd FROM bars)".format(m=full("avg", _TP, 20), s=full("stddev_samp", _TP, 20))
on_hours("band_shapes", ["bb_width", "bb_delta"], ind.band_shapes, "4 * sd / nullif(m, 0) ;; sd / nullif(m - 2 * sd, 0)", _BB)
_W26 = "OVER (PARTITION BY symbol ORDER BY time ROWS 25 PRECEDING)"
_CCI = f"tp AS (SELECT *, {_TP} AS t FROM bars), result AS (SELECT *, CASE WHEN n >= 26 THEN avg(t) {_W26} END AS m, list(t) {_W26} AS l FROM tp)"
on_hours("cci", ["cci_26"], lambda d: ind.cci(d, 26), "(t - m) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - m))), 0)", _CCI)
CCI_LENGTHS, RMI_LENGTHS = (26, 170, *range(25, 46)), range(8, 21)  # fixed values: the lengths that the rules choose from
CCI_LENGTHS = tuple(dict.fromkeys(CCI_LENGTHS))
_CCIS = f"tp AS (SELECT *, {_TP} AS t FROM bars), result AS (SELECT *, " + ", ".join(
    f"CASE WHEN n >= {k} THEN avg(t) OVER (PARTITION BY symbol ORDER BY time ROWS {k - 1} PRECEDING) END AS m{k}, list(t) OVER (PARTITION BY symbol ORDER BY time ROWS {k - 1} PRECEDING) AS l{k}" for k in CCI_LENGTHS
) + " FROM tp)"
on_hours("cci_family", [f"cci_{k}" for k in CCI_LENGTHS], lambda d: ind.cci(d, *CCI_LENGTHS), " ;; ".join(f"(t - m{k}) / nullif(0.015 * list_avg(list_transform(l{k}, lambda x: abs(x - m{k}))), 0)" for k in CCI_LENGTHS), _CCIS)
_GAP_BANDS = f"tr_ AS (SELECT *, {_TR} AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)), result AS (SELECT *, {full('avg', 'close', 20)} - 2 * {full('avg', 'tr', 20)} AS kl, {full('avg', _TP, 20)} - 2 * {full('stddev_samp', _TP, 20)} AS bl FROM tr_)"
on_hours("keltner_gap", ["kc_bb_delta"], ind.keltner_gap, "(kl - bl) / nullif(bl, 0) * 100", _GAP_BANDS, places=4)
_MFI = f"""tp AS (SELECT *, {_TP} AS t, lag({_TP}) OVER (PARTITION BY symbol ORDER BY time) AS p FROM bars), ud AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN t > p THEN t * volume ELSE 0 END AS up, CASE WHEN p IS NULL THEN NULL WHEN t < p THEN t * volume ELSE 0 END AS dn FROM tp),
    result AS (SELECT *, {full("sum", "up", 14)} AS u, {full("sum", "dn", 14)} AS d FROM ud)"""
on_hours("money_flow_index", ["mfi"], ind.money_flow_index, "CASE WHEN u + d = 0 THEN 50 ELSE 100 * u / (u + d) END", _MFI)
_SQUEEZE = f"""va AS (SELECT *, close - (({full("max", "high", 20)} + {full("min", "low", 20)}) / 2 + {full("avg", "close", 20)}) / 2 AS v FROM bars),
    result AS (SELECT *, CASE WHEN count(v) {_W20} = 20 THEN regr_slope(v, n) {_W20} * n + regr_intercept(v, n) {_W20} END AS line FROM va)"""
on_hours("squeeze_momentum", ["linreg_20"], ind.squeeze_momentum, "line", _SQUEEZE)
_GUARD = f"result AS (SELECT *, ({full('max', 'high', 5)} - {full('min', 'low', 5)}) / ({full('min', 'low', 5)}) AS hl, {full('min', 'low', 5, -1)} AS l5 FROM bars)"
on_hours("dump_guard", ["safe_dump"], ind.dump_guard, "!coalesce(hl < 0.66 OR close < l5 OR close > open, close > open, false)", _GUARD)
_DIV = f"""mo AS (SELECT *, close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY time) AS m FROM bars), ba AS (SELECT *, {full("avg", "m", 20)} AS mid, {full("stddev_pop", "m", 20)} AS sd FROM mo),
    cr AS (SELECT *, mid - 2 * sd AS low_b, mid + 2 * sd AS up_b, {full("max", "high", 30)} AS h30, {full("min", "low", 30)} AS l30 FROM ba), result AS (SELECT *, lag(m) OVER (PARTITION BY symbol ORDER BY time) AS pm, lag(low_b) OVER (PARTITION BY symbol ORDER BY time) AS pl, lag(up_b) OVER (PARTITION BY symbol ORDER BY time) AS pu FROM cr)"""
on_hours(
    "momentum_divergence", ["momdiv_buy", "momdiv_sell", "momdiv_coh", "momdiv_col"], ind.momentum_divergence,
    "!coalesce(m < low_b AND pm >= pl, false) ;; !coalesce(m > up_b AND pm <= pu, false) ;; !coalesce(high >= h30, false) ;; !coalesce(low <= l30, false)", _DIV,
)


def _averaged(periods: list[int], extra: str = "") -> str:
    """Averages of the close as columns e<period> of ``result``."""
    columns = ", ".join(f"max(CASE WHEN e.period = {p} AND e.n >= {p} THEN e.s END) AS e{p}" for p in periods)
    return f"{ema_sql(str(periods))}, ep AS (SELECT symbol, n, {columns} FROM e GROUP BY 1, 2), result AS (SELECT bars.*, {', '.join(f'e{p}' for p in periods)} FROM bars JOIN ep USING (symbol, n))"


on_hours("ewo", ["ewo"], ind.ewo, "(e50 - e200) / nullif(low, 0) * 100", _averaged([50, 200]))
on_hours("smoothed_roc", ["srocr"], ind.smoothed_roc, "(e13 / lag(e13, 21) OVER w - 1) * 100", _averaged([13]))
on_hours("rmi", ["rmi_17"], lambda d: ind.rmi(d, 17), "r", f"bars2 AS (SELECT *, greatest(close - lag(close, 4) OVER w, 0) AS up, greatest(lag(close, 4) OVER w - close, 0) AS dn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)), {_wilder_sql('up', 17, 'wu', 5)}, {_wilder_sql('dn', 17, 'wd', 5)}, result AS (SELECT bars.*, CASE WHEN wu.s + wd.s = 0 THEN 50 ELSE 100 * wu.s / (wu.s + wd.s) END AS r FROM bars LEFT JOIN wu USING (symbol, n) LEFT JOIN wd USING (symbol, n))")
_RMIS = "bars2 AS (SELECT *, greatest(close - lag(close, 4) OVER w, 0) AS up, greatest(lag(close, 4) OVER w - close, 0) AS dn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)), "
_RMIS += ", ".join(f"{_wilder_sql('up', k, f'wu{k}', 5)}, {_wilder_sql('dn', k, f'wd{k}', 5)}" for k in RMI_LENGTHS)
_RMIS += ", result AS (SELECT bars.*, " + ", ".join(f"CASE WHEN wu{k}.s + wd{k}.s = 0 THEN 50 ELSE 100 * wu{k}.s / (wu{k}.s + wd{k}.s) END AS r{k}" for k in RMI_LENGTHS) + " FROM bars " + " ".join(f"LEFT JOIN wu{k} USING (symbol, n) LEFT JOIN wd{k} USING (symbol, n)" for k in RMI_LENGTHS) + ")"
on_hours("rmi_family", [f"rmi_{k}" for k in RMI_LENGTHS], lambda d: ind.rmi(d, *RMI_LENGTHS), " ;; ".join(f"r{k}" for k in RMI_LENGTHS), _RMIS)


@query(
    "loss_score",
    f"""WITH RECURSIVE {_TRADES}{_DAILY}{_CURVE}, ls AS (SELECT symbol, max((high - cumulated) / (1000 + high)) AS dd, sum(profit_abs) / 10 AS pc FROM u GROUP BY 1),
    own_days AS (SELECT symbol, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
    od AS (SELECT d.symbol, d.day, coalesce(sum(profit_ratio - 0.0005), 0) AS profit FROM own_days d LEFT JOIN closed ON closed.symbol = d.symbol AND CAST(make_timestamp(close_time * 1000) AS DATE) = d.day GROUP BY 1, 2),
    lr AS (SELECT symbol, CASE WHEN stddev_samp(profit) > 0 THEN avg(profit) / stddev_samp(profit) * sqrt(365) ELSE -20 END AS sharpe FROM od GROUP BY 1)
    SELECT symbol, round(CASE WHEN 1 / (1 - dd) - 1 = 0 THEN 50 WHEN pc < 200 THEN -pc / (1 / (1 - dd) - 1) * sharpe ELSE 50 END,4) AS loss FROM ls JOIN lr USING (symbol)""",
    4,
)
def loss_score(spark, sf_dir):
    """A6, by symbol, with A3's Sharpe ratio of the daily profits between the symbol's first and last bar."""
    own = closed(spark, sf_dir)
    worst = tr.worst_drawdown(tr.underwater(own, CAPITAL, ["symbol"]), ["symbol"])
    made = own.groupBy("symbol").agg((F.sum("profit_abs") / 10).alias("pc"))
    sharpe = tr.daily_sharpe(tr.daily_profit(own, tr.calendar(hourly(spark, sf_dir), ("symbol",)), ("symbol",)), ("symbol",))
    return made.join(worst, "symbol").join(sharpe, "symbol").select("symbol", tr.loss_score(F.col("pc"), F.col("max_share"), F.col("sharpe")).alias("loss"))


@query("sweep_single_precision", places=4)
def sweep_single_precision(spark, sf_dir):
    """P7: prices kept in 32 bits."""
    return in_logs(bt.rank(scored(bt.cast_prices(hourly(spark, sf_dir), "f32"), GRID), GRID.params, 1))


# Indicators whose SQL is made of that of the rules, in rule_queries.

for _name, _columns, _fn in (
    ("moderi", ["moderi_96"], lambda d: ind.moderi(d, 96)), ("crsi", ["crsi"], ind.crsi), ("stochastic_rsi", ["srsi_k", "srsi_d"], ind.stochastic_rsi), ("adx", ["adx"], ind.adx), ("t3", ["t3"], ind.t3),
    ("moving_averages", ["dema", "tema", "wma"], lambda d: ind.moving_average(ind.moving_average(ind.moving_average(d, "dema", 9, "dema"), "tema", 9, "tema"), "wma", 9, "wma")),
):
    QUERIES[_name] = lambda spark, sf_dir, columns=_columns, fn=_fn: rounded(fn(hourly(spark, sf_dir)).select("symbol", "time", *columns))


from tickloom.plans import rule_queries  # noqa: E402, F401  adds the queries of the entry rules and exit reasons
