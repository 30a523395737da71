"""Signals, positions, equity and run summaries.

Two layouts give the same scores. The relational one, ``runs``, has a row for each bar and run, with
windows over (symbol, level, parameters); it takes any strategy and shows every bar. The array one
takes strategies that deal their parameters out in tiles: a task gets the arrays of a series' prices
and a tile, makes each average of the tile once, and gives one row for each run; only those rows are
shuffled. Series of large tables are cut in time (``split_sweep``), so that none has to fit in a task.

A position follows the last signal that isn't hold, one bar later. The value of a trade is its stake
times the price over the opening rate, and stakes are the running product of what trades returned, as a
sum of logarithms. Warm-up values are null, so comparisons with them hold.

Prices may be 0: a bar's value is then 0, the return of the bar after a value of 0 isn't counted, a sale at 0 leaves
nothing for the rest of the run, and a purchase at 0 buys without limit, so that the final value is infinite and the
Sharpe ratio 0; such runs rank by their ratio like all others. Negative prices aren't prices. ``after_loss`` has the returns
of the positions after a sale at 0 counted as well, by their prices; value and drawdown stay.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scan import SPLIT_BYTES, Linear, Step, ema_grid, estimated_bytes, recurrences
from tickloom.operators.build import periods_per_year
from tickloom.operators.joins import pair_emas
from tickloom.operators.split_sweep import split_scores

SERIES = ["symbol", "level"]


class Strategy(Protocol):
    """What the sweep needs of a strategy."""

    name: str
    #: parameter columns, in the order that breaks ties
    params: list[str]

    def grid(self, spark: SparkSession) -> DataFrame: ...
    def indicators(self, candles: DataFrame) -> DataFrame: ...
    def signal(self) -> Column: ...
    def text(self) -> Column: ...


def double_ema_signal(fast: Column, slow: Column) -> Column:
    """1 to enter, 0 to leave, null to hold."""
    return F.when(fast > slow, 1).when(fast < slow, 0)


def price_vs_ema_signal(close: Column, average: Column) -> Column:
    return F.when(close > average, 1).when(close < average, 0)


def pair_grid(spark: SparkSession, fast_min: int, slow_min: int, most: int) -> DataFrame:
    """(fast, slow): slow from slow_min, and above fast, to most."""
    one = spark.range(fast_min, most + 1).select(F.col("id").cast("int").alias("fast"))
    two = spark.range(max(slow_min, fast_min + 1), most + 1).select(F.col("id").cast("int").alias("slow"))
    return one.join(F.broadcast(two), F.col("slow") > F.col("fast"))


def period_grid(spark: SparkSession, least: int, most: int) -> DataFrame:
    return spark.range(least, most + 1).select(F.col("id").cast("int").alias("period"))


#: Periods on a side of a tile of averages; pairs whose averages one pass along a series makes.
TILE, FEW_PAIRS = 32, 64


def ema_values(close: np.ndarray, period: int) -> np.ndarray:
    """The ema of a whole series, NaN in its warm-up."""
    return Linear(Step("", "ema", "", period))(close)


def followed(above: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Whether the last signal up to each bar that isn't hold was to enter; ``equal`` bars hold."""
    if not equal.any():
        return above
    last = np.maximum.accumulate(np.where(equal, -1, np.arange(len(above))))
    return (last >= 0) & above[last]


class DoubleEma:
    """A fast and a slow average: all pairs with fast < slow of a range, or given ones."""

    name, params = "double_ema", ["fast", "slow"]

    def __init__(self, fast_min: int = 5, slow_min: int = 6, most: int = 600, pairs: list[tuple[int, int]] | None = None):
        if pairs:
            fast_min, slow_min, most = min(f for f, _ in pairs), min(s for _, s in pairs), max(s for _, s in pairs)
        self.range, self.pairs = (fast_min, slow_min, most), pairs

    def grid(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.pairs, "fast int, slow int") if self.pairs else pair_grid(spark, *self.range)

    def indicators(self, candles: DataFrame) -> DataFrame:
        own = candles.select(*SERIES, "time", "open", "close")
        if self.pairs and len(self.pairs) <= FEW_PAIRS:  # one pass makes just their averages
            made = recurrences(own, SERIES, [Step(f"ema_{p}", "ema", "close", p) for p in sorted({p for pair in self.pairs for p in pair})])
            pair = [F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(f"ema_{f}").alias("ema_fast"), F.col(f"ema_{s}").alias("ema_slow")) for f, s in self.pairs]
            return made.select(*own.columns, F.explode(F.array(*pair)).alias("pair")).select(*own.columns, "pair.*")
        return pair_emas(ema_grid(own, self.range[0], self.range[2], SERIES), self.grid(candles.sparkSession), SERIES)

    def signal(self) -> Column:
        return double_ema_signal(F.col("ema_fast"), F.col("ema_slow"))

    def text(self) -> Column:
        return F.format_string("fast=%d,slow=%d", "fast", "slow")

    def tiles(self) -> list[list[tuple[int, int]]]:
        """The pairs, in tiles of TILE by TILE periods."""
        first, least, most = self.range
        if self.pairs:
            return [self.pairs[k : k + TILE] for k in range(0, len(self.pairs), TILE)]
        corners = [(f, s) for f in range(first, most + 1, TILE) for s in range(least, most + 1, TILE)]
        found = [[(x, y) for x in range(f, min(f + TILE, most + 1)) for y in range(max(s, x + 1), min(s + TILE, most + 1))] for f, s in corners]
        return [t for t in found if t]

    def follow(self, close: np.ndarray, tile: list[tuple[int, int]]):
        """(parameters, whether each bar's last signal is to enter) of each pair of a tile."""
        made = {p: ema_values(close, p) for p in {p for pair in tile for p in pair}}
        for pair in tile:
            yield pair, followed(*self.compare(close, made, pair))  # NaN compares as neither, and nothing is held before

    def compare(self, close: np.ndarray, made: dict[int, np.ndarray], pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(whether each bar's signal is to enter, whether it is to hold)."""
        x, y = made[pair[0]], made[pair[1]]
        return x > y, x == y


class SingleEma:
    """The price against one average."""

    name, params = "single_ema", ["period"]

    def __init__(self, least: int = 5, most: int = 600):
        self.range = least, most

    def grid(self, spark: SparkSession) -> DataFrame:
        return period_grid(spark, *self.range)

    def indicators(self, candles: DataFrame) -> DataFrame:
        return ema_grid(candles.select(*SERIES, "time", "open", "close"), *self.range, SERIES)

    def signal(self) -> Column:
        return price_vs_ema_signal(F.col("close"), F.col("ema"))

    def text(self) -> Column:
        return F.format_string("period=%d", "period")

    def tiles(self) -> list[list[tuple[int]]]:
        every = [(p,) for p in range(self.range[0], self.range[1] + 1)]
        return [every[k : k + TILE] for k in range(0, len(every), TILE)]

    def follow(self, close: np.ndarray, tile: list[tuple[int]]):
        for (period,) in tile:
            yield (period,), followed(*self.compare(close, {period: ema_values(close, period)}, (period,)))

    def compare(self, close: np.ndarray, made: dict[int, np.ndarray], own: tuple[int]) -> tuple[np.ndarray, np.ndarray]:
        return close > made[own[0]], close == made[own[0]]


def positions(df: DataFrame, signal: Column, keys: list[str], order: str = "time") -> DataFrame:
    """df with ``held`` (0 or 1): the position in each bar; the first bar is flat."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_signal", signal)
    d = d.withColumn("_kept", F.last("_signal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("held", F.coalesce(F.lag("_kept").over(w), F.lit(0))).drop("_signal", "_kept")


def growth(df: DataFrame, fee: float, keys: list[str], order: str = "time") -> DataFrame:
    """df with ``factor``, by how much the portfolio grows in each bar (null after a close of 0), and ``kept``, what each bar of a trade, its sale included, leaves of the stake; entries and exits at the open, fees on both."""
    w = Window.partitionBy(*keys).orderBy(order)
    was, close = F.coalesce(F.lag("held").over(w), F.lit(0)), F.lag("close").over(w)
    enter, leave, stay = (F.col("held") == 1) & (was == 0), (F.col("held") == 0) & (was == 1), (F.col("held") == 1) & (was == 1)
    factor = F.when(enter, (1 - fee) * F.try_divide(F.col("close"), F.col("open"))).when(leave, (1 - fee) * F.try_divide(F.col("open"), close)).when(stay, F.try_divide(F.col("close"), close)).otherwise(F.lit(1.0))
    rate = F.last(F.when(enter, F.col("open")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    share = lambda x: F.when(rate == 0, F.when(x == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(x, rate))
    kept = F.when(F.col("held") == 1, (1 - fee) * share(F.col("close"))).when(leave, (1 - fee) * (1 - fee) * share(F.col("open")))
    return df.withColumn("factor", factor).withColumn("kept", kept)


def equity(df: DataFrame, capital: float, keys: list[str], order: str = "time", after_loss: bool = False) -> DataFrame:
    """df (held, kept) with ``value``, its running peak, and the return of each bar but the first and those after a value of 0; after_loss: after a sale at 0 the factor less one."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    w = ordered.rowsBetween(Window.unboundedPreceding, 0)
    sold = F.when(F.col("held") == 0, F.col("kept"))
    gone = F.coalesce(F.max(F.when(sold == 0, 1)).over(w), F.lit(0)) == 1
    cash = F.when(gone, 0.0).otherwise(capital * F.exp(F.coalesce(F.sum(F.log(sold)).over(w), F.lit(0.0))))
    d = df.withColumn("value", cash * F.when(F.col("held") == 1, F.col("kept")).otherwise(1.0))
    before = F.lag("value").over(ordered)
    d = d.withColumn("peak", F.max(F.when(~F.isnan("value"), F.col("value"))).over(w))
    ret = F.when(before > 0, F.try_divide(F.col("value"), before) - 1)
    return d.withColumn("ret", F.coalesce(ret, F.when(gone, F.col("factor") - 1)) if after_loss else ret).drop("kept")


def max_drawdown(value: str = "value", peak: str = "peak") -> Column:
    """Aggregate: the deepest fall from the running peak, in percent; none from a peak without limit."""
    fall = F.when((F.col(peak) > 0) & (F.col(peak) < float("inf")) & ~F.isnan(value), F.try_divide(F.col(peak) - F.col(value), F.col(peak)) * 100)
    return F.coalesce(F.max(fall), F.lit(0.0))


def sharpe(ret: str, per_year: int, rf: float = 0.0) -> Column:
    """Aggregate: yearly Sharpe ratio of per-bar returns; 0 with under two returns or without variation."""
    sd = F.stddev_samp(ret)
    good = (F.count(ret) >= 2) & sd.isNotNull() & ~F.isnan(sd) & (sd > 1e-15) & F.lit(per_year > 0)
    return F.when(good, (F.avg(ret) - rf) / sd * F.sqrt(F.lit(float(per_year)))).otherwise(F.lit(0.0))


def cast_prices(candles: DataFrame, precision: str) -> DataFrame:
    """Prices as stored in 32 (f32) or 64 bits (f64); sums stay in 64 bits."""
    kind = {"f32": "float", "f64": "double"}[precision]
    return candles.withColumns({c: F.col(c).cast(kind).cast("double") for c in ("open", "high", "low", "close")})


def runs(candles: DataFrame, strategy: Strategy, fee: float, capital: float, after_loss: bool = False) -> DataFrame:
    """Every bar of every run: position, factor, value, peak and return. ``split_sweep.split_runs`` has them for series cut in time."""
    keys = [*SERIES, *strategy.params]
    d = strategy.indicators(candles)
    return equity(growth(positions(d, strategy.signal(), keys), fee, keys), capital, keys, after_loss=after_loss)


def relational_scores(candles: DataFrame, strategy: Strategy, level: str, fee: float, capital: float, after_loss: bool = False) -> DataFrame:
    d = runs(candles.where(F.col("level") == level), strategy, fee, capital, after_loss)
    return d.groupBy(*SERIES, *strategy.params).agg(F.max_by("value", "time").alias("final_value"), max_drawdown().alias("max_dd"), sharpe("ret", periods_per_year(level)).alias("sharpe"), F.count("*").alias("bars"))


class Scorer:
    """Scores runs over one series from the bars in which the position changes.

    Between an entry and an exit the value goes with the close, so sums of returns and of their squares are differences of prefix sums,
    and the value's extremes are those of the close. A fall within one trade is followed bar by bar only where the trade's range exceeds the deepest fall found."""

    def __init__(self, opens: np.ndarray, closes: np.ndarray, fee: float, capital: float, per_year: int, after_loss: bool = False):
        self.n, self.capital, self.per_year, self.fee, self.after_loss = len(closes), capital, per_year, float(np.log1p(-fee)), after_loss
        before = np.concatenate([closes[:1], closes[:-1]])
        self.zeros = bool((closes == 0).any() or (opens == 0).any())
        self.free = opens == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            self.enter, self.leave = (1 - fee) * closes / opens - 1, (1 - fee) * opens / before - 1
            self.open, self.close, change = np.log(opens), np.log(closes), closes / before - 1
        if self.zeros:  # returns after a value of 0 don't count
            self.lost = np.concatenate([[0], np.cumsum(before == 0)])
            change[before == 0] = self.leave[before == 0] = 0.0
        self.sums = [np.concatenate([[0.0], np.cumsum(change**k)]) for k in (1, 2)]

    def __call__(self, follow: np.ndarray) -> tuple[float, float, float]:
        """(final value, drawdown in percent, Sharpe ratio) of positions that follow each bar's signal one bar later."""
        n = self.n
        change = np.flatnonzero(follow[1:-1] != follow[:-2]) + 2
        if n > 1 and follow[0]:
            change = np.concatenate([[1], change])
        into, out, bars, without_limit = change[::2], change[1::2], n, False
        counted = None  # trades whose returns count
        if self.zeros:
            # a purchase or a sale at 0 ends what there is to follow
            bought = np.flatnonzero(self.free[into])[:1]
            sold = np.flatnonzero(self.free[out])[:1]
            if len(bought) and (not len(sold) or bought[0] <= sold[0]):
                into, out, without_limit = into[: bought[0]], out[: bought[0]], True
            elif len(sold):
                if self.after_loss:
                    counted = into, out
                into, out = into[: sold[0] + 1], out[: sold[0] + 1]
                bars = n if self.after_loss else int(out[-1]) + 1
                if self.after_loss and len(bought):
                    return 0.0, self.value(into, out)[1], 0.0
        if not len(into):
            return float("inf") if without_limit else self.capital, 0.0, 0.0
        with np.errstate(invalid="ignore"):
            final, fall = self.value(into, out)
        if without_limit:
            return float("inf"), fall, 0.0
        into, out = counted or (into, out)
        end = out if len(out) == len(into) else np.append(out, n)
        a, b = self.enter[into], self.leave[out]
        one, two = ((s[end] - s[into + 1]).sum() + (a**k).sum() + (b**k).sum() for k, s in enumerate(self.sums, 1))
        count = bars - 1
        if self.zeros:
            count -= int((self.lost[np.minimum(end + 1, n)] - self.lost[into + 1]).sum())  # the bar of the sale included
        ratio = 0.0
        if count > 1 and self.per_year > 0:
            mean = one / count
            sd = np.sqrt(max(0.0, (two - count * mean * mean) / (count - 1)))
            ratio = mean / sd * np.sqrt(self.per_year) if sd > 1e-15 else 0.0
        return final, fall, float(ratio)

    def value(self, into: np.ndarray, out: np.ndarray) -> tuple[float, float]:
        """(final value, drawdown in percent) of trades from into to out, the last of them open if out is shorter."""
        n = self.n
        end = out if len(out) == len(into) else np.append(out, n)
        # logarithms of the value: when a trade begins, less the close's while it lasts, when it has ended
        paid = self.fee - self.open[into]
        gain = paid + self.close[end - 1]
        gain[: len(out)] = paid[: len(out)] + self.open[out] + self.fee
        after = np.cumsum(gain)
        offset = np.concatenate([[0.0], after[:-1]]) + paid
        bounds = np.column_stack([into, end]).ravel()
        bounds = bounds[:-1] if bounds[-1] == n else bounds
        high, low = (f.reduceat(self.close, bounds)[::2] for f in (np.maximum, np.minimum))
        top = np.maximum(offset + high, after)
        peak = np.maximum.accumulate(np.concatenate([[0.0], top]))[:-1]
        fall = max(0.0, float((peak - offset - low).max()), float((np.maximum(peak, offset + high) - after).max()))
        wide = high - low
        for k in np.flatnonzero(wide > fall)[np.argsort(-wide[wide > fall], kind="stable")].tolist():
            if wide[k] <= fall:
                break
            own = self.close[into[k] : end[k]]
            fall = max(fall, float((np.maximum.accumulate(own) - own).max()))
        return self.capital * float(np.exp(after[-1])), float(-np.expm1(-fall) * 100)


def array_scores(candles: DataFrame, strategy: DoubleEma | SingleEma, level: str, fee: float, capital: float, split: bool | None = None, after_loss: bool = False) -> DataFrame:
    """Scores of tiles of parameters; series cut in time or not, if split doesn't leave it to the table's size."""
    if estimated_bytes(candles) >= SPLIT_BYTES if split is None else split:
        return split_scores(candles, strategy, level, fee, capital, after_loss)
    tiles, per_year = strategy.tiles(), periods_per_year(level)
    bars = F.sort_array(F.collect_list(F.struct("time", "open", "close")))
    arrays = candles.where(F.col("level") == level).groupBy(*SERIES).agg(bars.alias("b")).select(*SERIES, F.col("b.open").alias("open"), F.col("b.close").alias("close"))
    spark = candles.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(tiles), 10_000))
    dealt = arrays.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(len(tiles) - 1)))).repartition(tasks, *SERIES, "tile")

    def run(batches):
        held, scorer = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                symbol, own_level, opens, closes, tile = (batch.column(c)[k] for c in range(5))
                opens, closes = (numbers.values.to_numpy(zero_copy_only=False) for numbers in (opens, closes))
                if held != (symbol, own_level):
                    held, scorer = (symbol, own_level), Scorer(opens, closes, fee, capital, per_year, after_loss)
                found = [(params, scorer(follow)) for params, follow in strategy.follow(closes, tiles[tile.as_py()])]
                n = len(found)
                names = [[symbol.as_py()] * n, [own_level.as_py()] * n]
                columns = [pa.array(x, pa.string()) for x in names] + [pa.array(x, pa.int32()) for x in zip(*(p for p, _ in found), strict=True)] + [pa.array(x, pa.float64()) for x in zip(*(x for _, x in found), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(closes)] * n, pa.int64())], names=[*SERIES, *strategy.params, "final_value", "max_dd", "sharpe", "bars"])

    return dealt.mapInArrow(run, f"symbol string, level string, {', '.join(f'{p} int' for p in strategy.params)}, final_value double, max_dd double, sharpe double, bars long")


def backtest(candles: DataFrame, strategy: Strategy, level: str, fee: float = 0.0015, capital: float = 1000.0, after_loss: bool = False) -> DataFrame:
    """One row for each series and parameter row: final value, drawdown in percent, Sharpe ratio, bars."""
    return (array_scores if hasattr(strategy, "tiles") else relational_scores)(candles, strategy, level, fee, capital, after_loss=after_loss)


def rank(scores: DataFrame, params: list[str], k: int) -> DataFrame:
    """The k best rows of each series: finite Sharpe ratios first, then Sharpe, final value, and the parameters in order."""
    finite = F.col("sharpe").isNotNull() & ~F.isnan("sharpe") & (F.abs("sharpe") < float("inf"))
    w = Window.partitionBy(*SERIES).orderBy(F.desc(finite), F.desc(F.when(finite, F.col("sharpe"))), F.desc("final_value"), *params)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def trades(df: DataFrame, keys: list[str], fee: float, capital: float) -> DataFrame:
    """Closed round trips of runs (held, open, close, value): opening and closing time and rate, profit after fees."""
    w = Window.partitionBy(*keys).orderBy("time")
    d = df.withColumn("_was", F.coalesce(F.lag("held").over(w), F.lit(0))).withColumn("_before", F.coalesce(F.lag("value").over(w), F.lit(capital)))
    d = d.withColumn("_trade", F.sum(F.when((F.col("held") == 1) & (F.col("_was") == 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    enter, leave = (F.col("held") == 1) & (F.col("_was") == 0), (F.col("held") == 0) & (F.col("_was") == 1)
    pick = lambda when, c: F.max(F.when(when, F.col(c)))
    own = d.where(enter | leave).groupBy(*keys, F.col("_trade").alias("trade_id")).agg(
        pick(enter, "time").alias("open_time"), pick(leave, "time").alias("close_time"), pick(enter, "open").alias("open_rate"), pick(leave, "open").alias("close_rate"), pick(enter, "_before").alias("stake")
    )
    ratio = (1 - fee) * (1 - fee) * F.col("close_rate") / F.col("open_rate") - 1
    return own.where("close_time is not null").select(*keys, "trade_id", "open_time", "close_time", "open_rate", "close_rate", ratio.alias("profit_ratio"), (F.col("stake") * ratio).alias("profit_abs"), F.lit("signal").alias("exit_reason"))
