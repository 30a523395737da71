"""Sweeps and runs over series that are too long for one task: runs are scored by stretches of time and put together.

A series is cut into stretches of about ``scan.STRETCH`` bars. An average over a stretch goes on linearly from its value before, so
a first pass reduces each stretch to what its bars add to each average, and the averages with which it begins follow in
order, a row for each stretch. A second pass goes through each stretch from there, with the two bars before it, and gives a summary of
each run: what its value is multiplied by, its top, bottom and deepest fall, and the sums of its returns, all relative to how the stretch
begins. Whether a run holds then is what its averages say of the bars before; if those hold (equal averages, warm-up), the summary is
made for both. Summaries of a run are put together in order. Results are those of ``backtest.array_scores``; ``split_runs`` goes through
the stretches once more, from the value, peak and position with which each begins, and gives the bars of ``backtest.runs``.

A task holds one stretch and the averages, or the summaries of ``PAIRS`` runs of one series.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scan import STRETCH, run_linear
from tickloom.operators.build import LEVELS, periods_per_year

#: Runs that are put together in a task, and tiles that a task goes through.
PAIRS, TILES = 128, 16
#: Fields of a run's summary of a stretch: how it ends (1: sold at 0, 2: bought at 0, 3: both, and returns after the sale count), whether the last bar and the one before are followed, then logarithms of the value's change, top, bottom and deepest fall, sums and number of returns.
FIELDS = ("ended", "last", "before_last", "change", "top", "low", "fall", "one", "two", "count")
SERIES = ["symbol", "level"]


def averages(close: np.ndarray, periods: list[int], begin: np.ndarray) -> dict[int, np.ndarray]:
    """Each period's average over a stretch that it begins with ``begin``, warm-up values included."""
    out = {}
    for p, s in zip(periods, begin.tolist(), strict=True):
        q = 1 - 2 / (p + 1)
        out[p] = run_linear(close * (1 - q), q, s)
    return out


class Stretch:
    """Bars of a stretch, with the two before it in front (if there are any), to summarise runs over."""

    def __init__(self, opens: np.ndarray, closes: np.ndarray, fee: float, first: bool, after_loss: bool = False):
        """opens and closes have two bars in front; those of the first stretch are made up and never held."""
        self.fee, self.first, self.n, self.after_loss = float(np.log1p(-fee)), first, len(closes), after_loss
        before = np.concatenate([closes[:1], closes[:-1]])
        self.free, self.lost = opens == 0, np.concatenate([[0], np.cumsum(before == 0)])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.enter, self.leave, change = (1 - fee) * closes / opens - 1, (1 - fee) * opens / before - 1, closes / before - 1
            self.open, self.close = np.log(opens), np.log(closes)
        change[before == 0] = self.leave[before == 0] = 0.0
        self.sums = [np.concatenate([[0.0], np.cumsum(change**k)]) for k in (1, 2)]

    def values(self, follow: np.ndarray, value: float, ended: int) -> np.ndarray:
        """The value at the last bar before the stretch and at each of its bars; value is the logarithm that the run begins with (of an open trade: less the close's)."""
        n = self.n
        held = np.concatenate([follow[:1], follow[:-1]])[1:]  # from the last bar before the stretch on
        if ended:
            return np.full(n - 1, 0.0 if ended == 1 else np.inf)
        entered = np.flatnonzero(held[1:] & ~held[:-1]) + 2
        left = np.flatnonzero(~held[1:] & held[:-1]) + 2
        with np.errstate(invalid="ignore", divide="ignore"):
            steps = np.zeros(n)
            steps[entered] = self.fee - self.open[entered]
            steps[left] = self.open[left] + self.fee
            base = value + np.cumsum(steps)[1:]
            return np.exp(base + np.where(held, self.close[1:], 0.0))

    def summary(self, follow: np.ndarray) -> list[float]:
        """FIELDS of a run that follows each bar's signal one bar later; a trade may be open before the stretch."""
        n, ended, bars = self.n, 0, self.n
        change = np.flatnonzero(follow[1:-1] != follow[:-2]) + 2
        held = bool(follow[0])
        if held:
            change = np.concatenate([[1], change])
        into, out = change[::2], change[1::2]
        bought = np.flatnonzero(self.free[into] & (into > 1))[:1]
        sold = np.flatnonzero(self.free[out])[:1]
        counted = None  # trades whose returns count
        if len(bought) and (not len(sold) or bought[0] <= sold[0]):
            ended, bars, into, out = 2, int(into[bought[0]]), into[: bought[0]], out[: bought[0]]
        elif len(sold):
            if self.after_loss:
                counted = into, out
            ended, into, out = 3 if self.after_loss and len(bought) else 1, into[: sold[0] + 1], out[: sold[0] + 1]
            bars = n if self.after_loss else int(out[-1]) + 1
        count = bars - 2 - self.first
        last, before_last = float(follow[-1]), float(follow[-2])
        if not len(into):
            return [ended, last, before_last, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, count]
        end = out if len(out) == len(into) else np.append(out, n)
        with np.errstate(invalid="ignore"):
            paid = self.fee - self.open[into]
            if held:
                paid[0] = 0.0  # the value before is relative to this trade
            gain = np.zeros(len(into))
            gain[: len(out)] = paid[: len(out)] + self.open[out] + self.fee
            after = np.cumsum(gain)
            offset = np.concatenate([[0.0], after[:-1]]) + paid
            bounds = np.column_stack([into, end]).ravel()
            bounds = bounds[:-1] if bounds[-1] == n else bounds
            high, low = (f.reduceat(self.close, bounds)[::2] for f in (np.maximum, np.minimum))
            tops, lows = offset + high, offset + low
            flat = after[: len(out)]  # the value when a trade has ended
            fall = 0.0
            peak = -np.inf if held else 0.0
            ends = np.concatenate([flat, np.full(len(into) - len(out), -np.inf)])
            peaks = np.maximum.accumulate(np.concatenate([[peak], np.maximum(tops, ends)]))
            fall = max(fall, float(np.max(peaks[:-1] - lows)), float(np.max(np.maximum(peaks[:-1], tops)[: len(out)] - flat, initial=0.0)))
            wide = high - low
            for k in np.flatnonzero(wide > fall)[np.argsort(-wide[wide > fall], kind="stable")].tolist():
                if wide[k] <= fall:
                    break
                own = self.close[into[k] : end[k]]
                fall = max(fall, float((np.maximum.accumulate(own) - own).max()))
        top, bottom = float(peaks[-1]), float(min(lows.min(), flat.min(initial=np.inf), np.inf if held else 0.0))
        total = float(offset[-1]) if len(out) < len(into) else float(after[-1])
        into, out = counted or (into, out)
        end = out if len(out) == len(into) else np.append(out, n)
        new = into[1:] if held else into
        a, b = self.enter[new], self.leave[out]
        one, two = ((s[end] - s[into + 1]).sum() + (a**k).sum() + (b**k).sum() for k, s in enumerate(self.sums, 1))
        count -= int((self.lost[np.minimum(end + 1, n)] - self.lost[into + 1]).sum())
        return [ended, last, before_last, total, top, bottom, fall, float(one), float(two), count]


@dataclass
class Cut:
    """Series of a level cut into stretches, for a strategy: the tables that the passes share, and what they know of it."""

    strategy: object
    tiles: list
    periods: list[int]
    fee: float
    #: a row for each stretch with its opens and closes and what it begins with
    stretches: DataFrame
    summaries: DataFrame
    after_loss: bool = False

    def follows(self, open_: np.ndarray, close: np.ndarray, begin: np.ndarray, tile: list) -> tuple[Stretch, np.ndarray, int, Iterator]:
        """(the stretch with two bars in front, its closes, bars before it, for each run of the tile: what it follows, and whether what it follows two bars before isn't known)."""
        k, seen = len(self.periods), int(begin[0])
        close = np.concatenate([begin[[2, 1]], close])
        own = Stretch(np.concatenate([[1.0, 1.0], open_]), close, self.fee, seen == 0, self.after_loss)
        place = np.arange(seen - 1, seen + len(close) - 1)  # the number of each bar in its series, from 1
        states = begin[3 : 3 + k], begin[3 + k :]
        at = {p: j for j, p in enumerate(self.periods)}
        needed = sorted({p for pair in tile for p in pair})
        made = averages(close[2:], needed, states[0][[at[p] for p in needed]])
        made = {p: np.where(place >= max(1, p), np.concatenate([[states[1][at[p]], states[0][at[p]]], v]), np.nan) for p, v in made.items()}

        def each() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
            for pair in tile:
                above, equal = self.strategy.compare(close, made, pair)
                holds = equal | np.logical_or.reduce([np.isnan(made[p]) for p in pair])
                last = np.maximum.accumulate(np.where(holds, -1, np.arange(len(above))))
                yield (last >= 0) & above[last], last < 0, bool(holds[0] and seen > 0)

        return own, close, seen, each()


def doubles(x: pa.Array, k: int) -> np.ndarray:
    return x[k].values.to_numpy(zero_copy_only=False)


def cut_in_time(candles: DataFrame, strategy, level: str, fee: float, after_loss: bool = False) -> Cut:
    tiles = strategy.tiles()
    periods = sorted({p for tile in tiles for pair in tile for p in pair})
    decay = np.array([1 - 2 / (p + 1) for p in periods])
    span = ({x[0]: x[1] for x in LEVELS}[level] or 30 * 86_400_000) * STRETCH
    bars = F.sort_array(F.collect_list(F.struct("time", "open", "close")))  # a stretch's
    cut = candles.where(F.col("level") == level).groupBy(*SERIES, F.floor(F.col("time") / span).alias("stretch")).agg(bars.alias("b"))
    cut = cut.select(*SERIES, "stretch", F.col("b.time").alias("time"), F.col("b.open").alias("open"), F.col("b.close").alias("close"))
    names = "symbol string, level string"
    per_stretch = len(periods)

    def reduced(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                close = doubles(batch["close"], k)
                found = averages(close, periods, np.zeros(per_stretch))
                ends = [[found[p][j] if len(close) >= -j else 0.0 for p in periods] for j in (-1, -2)]
                rows.append([float(len(close)), close[0], close[-1], close[-2] if len(close) > 1 else np.nan, *ends[0], *ends[1]])
            yield pa.RecordBatch.from_arrays([batch["symbol"], batch["level"], batch["stretch"], pa.array(rows, pa.list_(pa.float64()))], names=[*SERIES, "stretch", "held"])

    def carried(stretches: pa.Table) -> pa.Table:
        """What each stretch begins with: bars before, the closes of the last two, and the averages after each of them."""
        stretches = stretches.take(pa.array(np.argsort(stretches["stretch"].to_numpy(), kind="stable")))
        begins, seen, state = [], 0, None
        for held in stretches["held"]:
            held = held.values.to_numpy()
            n, first, last, before = held[:4]
            one, two = held[4 : 4 + per_stretch], held[4 + per_stretch :]
            if state is None:
                state = (first, first, np.full(per_stretch, first), np.full(per_stretch, first))
            begins.append(np.concatenate([[seen, state[0], state[1]], state[2], state[3]]).tolist())
            ended = decay**n * state[2] + one
            state = (last, before, ended, decay ** (n - 1) * state[2] + two) if n > 1 else (last, state[0], ended, state[2])
            seen += int(n)
        return pa.table({**{c: stretches[c] for c in (*SERIES, "stretch")}, "begin": pa.array(begins, pa.list_(pa.float64()))})

    def summarised(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile_from = batch["tile_from"][k].as_py()
                for number in range(tile_from, min(len(tiles), tile_from + TILES)):
                    own, close, _, follows = found_cut.follows(doubles(batch["open"], k), doubles(batch["close"], k), doubles(batch["begin"], k), tiles[number])
                    for a in range(0, len(tiles[number]), PAIRS):
                        found, other, which = [], [], []
                        for j, (follow, open_, unknown) in enumerate(islice(follows, PAIRS)):
                            found.append(own.summary(follow))
                            if unknown:  # what is followed two bars before the stretch may be either
                                other.append(own.summary(follow | open_))
                                which.append(j)
                        yield pa.RecordBatch.from_arrays(
                            [batch["symbol"].slice(k, 1), batch["level"].slice(k, 1), batch["stretch"].slice(k, 1), pa.array([number], pa.int32()), pa.array([a], pa.int32()), pa.array([len(close) - 2], pa.int64()), pa.array([close[-1]], pa.float64())]
                            + [pa.array([np.array(x, float).ravel().tolist()], pa.list_(pa.float64())) for x in (found, other, which)],
                            names=[*SERIES, "stretch", "tile", "from", "n", "last_close", "found", "other", "which"],
                        )

    found_cut = Cut(strategy, tiles, periods, fee, None, None, after_loss)
    begins = cut.mapInArrow(reduced, f"{names}, stretch long, held array<double>").groupBy(*SERIES).applyInArrow(carried, f"{names}, stretch long, begin array<double>")
    stretches = cut.join(begins, [*SERIES, "stretch"])
    dealt = stretches.drop("time").withColumn("tile_from", F.explode(F.sequence(F.lit(0), F.lit(len(tiles) - 1), F.lit(TILES)))).repartition(*SERIES, "stretch", "tile_from")
    summaries = dealt.mapInArrow(summarised, f"{names}, stretch long, tile int, `from` int, n long, last_close double, found array<double>, other array<double>, which array<double>")
    return Cut(strategy, tiles, periods, fee, stretches, summaries)


@dataclass
class Runs:
    """Runs of one series while their stretches are put together: logarithms of value (of a trade that is open: less the close's), peak and deepest fall, sums and number of returns."""

    n: int
    #: whether returns after a sale at 0 count
    after_loss: bool = False

    def __post_init__(self):
        self.value, self.peak, self.fall, self.one, self.two, self.count, self.ended, self.held = (np.zeros(self.n) for _ in range(8))

    def add(self, found: pa.ListScalar, other: pa.ListScalar, which: pa.ListScalar) -> None:
        own = found.values.to_numpy().reshape(self.n, len(FIELDS)).copy()
        rest, where = other.values.to_numpy().reshape(-1, len(FIELDS)), which.values.to_numpy().astype(int)
        longer = self.held[where] == 1
        own[where[longer]] = rest[longer]
        own = dict(zip(FIELDS, own.T, strict=True))
        on = self.ended == 0
        with np.errstate(invalid="ignore"):
            self.fall = np.where(on, np.maximum.reduce([self.fall, own["fall"], self.peak - self.value - own["low"]]), self.fall)
            self.peak = np.where(on, np.maximum(self.peak, self.value + own["top"]), self.peak)
        self.value = np.where(on, self.value + own["change"], self.value)
        counts = on | (self.ended == 1) if self.after_loss else on
        self.one, self.two, self.count = (np.where(counts, x + own[c], x) for x, c in ((self.one, "one"), (self.two, "two"), (self.count, "count")))
        both = counts & ~on & (own["ended"] >= 2)
        self.ended, self.held = np.where(on, own["ended"], np.where(both, 3, self.ended)), own["before_last"]


def in_order(rows: pa.Table) -> pa.Table:
    return rows.take(pa.array(np.argsort(rows["stretch"].to_numpy(), kind="stable")))


def split_scores(candles: DataFrame, strategy, level: str, fee: float, capital: float, after_loss: bool = False) -> DataFrame:
    """backtest.array_scores of series that are dealt by stretches of time."""
    per_year, params = periods_per_year(level), list(strategy.params)
    cut = cut_in_time(candles, strategy, level, fee, after_loss)
    tiles = cut.tiles

    def put_together(rows: pa.Table) -> pa.Table:
        rows = in_order(rows)
        tile = tiles[rows["tile"][0].as_py()][rows["from"][0].as_py() :][:PAIRS]
        n, runs = len(tile), Runs(len(tile), after_loss)
        for summary in zip(*(rows[c] for c in ("found", "other", "which")), strict=True):
            runs.add(*summary)
        one, two, count = runs.one, runs.two, runs.count
        with np.errstate(divide="ignore", invalid="ignore"):
            last = np.log(rows["last_close"].to_numpy()[-1])
            final = np.select([runs.ended % 2 == 1, runs.ended == 2], [0.0, np.inf], capital * np.exp(runs.value + np.where(runs.held == 1, last, 0.0)))
            mean = one / count
            sd = np.sqrt(np.maximum(0.0, (two - count * mean * mean) / (count - 1)))
            sharpe = np.where((count > 1) & (sd > 1e-15) & (runs.ended < 2) & (per_year > 0), mean / sd * np.sqrt(per_year), 0.0)
        fixed = {c: [rows[c][0].as_py()] * n for c in SERIES}
        bars = pa.array([sum(rows["n"].to_pylist())] * n, pa.int64())
        return pa.table({**fixed, **{c: pa.array(x, pa.int32()) for c, x in zip(params, zip(*tile, strict=True), strict=True)}, "final_value": final, "max_dd": -np.expm1(-runs.fall) * 100, "sharpe": sharpe, "bars": bars})

    return cut.summaries.groupBy(*SERIES, "tile", "from").applyInArrow(put_together, f"symbol string, level string, {', '.join(f'{p} int' for p in params)}, final_value double, max_dd double, sharpe double, bars long")


def split_runs(candles: DataFrame, strategy, level: str, fee: float, capital: float) -> DataFrame:
    """Every bar of every run, as backtest.runs has them, of series that are dealt by stretches of time: position, value, peak and return."""
    params = list(strategy.params)
    cut = cut_in_time(candles, strategy, level, fee)
    alone, tiles = Cut(strategy, cut.tiles, cut.periods, fee, None, None), cut.tiles

    def begun(rows: pa.Table) -> pa.Table:
        """What each stretch's runs begin with: value, peak, whether something is held, how they ended."""
        rows = in_order(rows)
        runs, states = Runs(len(tiles[rows["tile"][0].as_py()][rows["from"][0].as_py() :][:PAIRS])), []
        for summary in zip(*(rows[c] for c in ("found", "other", "which")), strict=True):
            states.append(np.concatenate([runs.value, runs.peak, runs.held, runs.ended]).tolist())
            runs.add(*summary)
        return pa.table({**{c: rows[c] for c in (*SERIES, "stretch", "tile", "from")}, "state": pa.array(states, pa.list_(pa.float64()))})

    def gone_through(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                tile = tiles[batch["tile"][k].as_py()][batch["from"][k].as_py() :][:PAIRS]
                own, close, seen, follows = alone.follows(doubles(batch["open"], k), doubles(batch["close"], k), doubles(batch["begin"], k), tile)
                states = doubles(batch["state"], k).reshape(4, len(tile))
                for pair, (follow, open_, unknown), (value, peak, held, ended) in zip(tile, follows, states.T, strict=True):
                    follow = follow | open_ if unknown and held else follow
                    values = capital * own.values(follow, value, int(ended))
                    peaks = np.fmax.accumulate(np.concatenate([[capital * np.exp(peak)], values[1:]]))[1:]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        returns = np.where(values[:-1] > 0, values[1:] / values[:-1] - 1, np.nan)
                    if seen == 0:
                        returns[0] = np.nan
                    n = len(close) - 2
                    fixed = [pa.array([batch[c][k].as_py()] * n, pa.string()) for c in SERIES] + [pa.array([p] * n, pa.int32()) for p in pair]
                    rows = [batch["time"][k].values, pa.array(doubles(batch["open"], k)), pa.array(close[2:]), pa.array(follow[1:-1].astype(np.int32)), pa.array(values[1:]), pa.array(peaks)]
                    yield pa.RecordBatch.from_arrays([*fixed, *rows, pa.array(returns, mask=~(values[:-1] > 0) | (np.arange(n) == 0) & (seen == 0))], names=[*SERIES, *params, "time", "open", "close", "held", "value", "peak", "ret"])

    states = cut.summaries.groupBy(*SERIES, "tile", "from").applyInArrow(begun, "symbol string, level string, stretch long, tile int, `from` int, state array<double>")
    dealt = cut.stretches.join(states, [*SERIES, "stretch"])
    return dealt.mapInArrow(gone_through, f"symbol string, level string, {', '.join(f'{p} int' for p in params)}, time long, open double, close double, held int, value double, peak double, ret double")
