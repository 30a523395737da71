"""Trades of the rule strategy: entries by the rules, each open until its first exit, one at a time in a series.

A signal to enter at the close of a bar opens a trade at the next bar's open. A bar ends the trade by the
first of: the trailing stop (its low reaches the stop that the closes before have set; at the stop), the
chain of exit reasons, and the take-profit for the trade's age (both at its close). A signal
while a trade is open is passed over; one in the bar that ends it counts.

What a bar's features say doesn't depend on the trade, so Spark evaluates it for all bars (``rules.held_rules``).
What is left depends on the trade before, and goes along a series in order, as in ``scan``: the bars of an open
trade are tested in runs of rows at once, and a task keeps one open trade from batch to batch.

Defined results: no trade opens at a rate of 0; an empty tag is null and called ``empty``; a trade that is open at the end isn't returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.indicators import KEYS
from tickloom.functions.scan import numbers, segments
from tickloom.operators import rules
from tickloom.operators.exits import BASE_STOP, STOP_TIERS, TAKE_TIERS

STOP, TAKE = "trailing_stop", "take_profit"
#: Rows of an open trade that are tested first; then twice as many, and so on.
FIRST_RUN = 32


@dataclass
class Bounds:
    """What the reasons ask of a trade, by reason."""

    names: list[str]
    at_least: np.ndarray
    above: np.ndarray
    below: np.ndarray
    fall: np.ndarray
    tags: list[str | None]

    @classmethod
    def of(cls, chain: list[rules.ExitRule]) -> Bounds:
        fall = [-np.inf if r.fall is None else r.fall for r in chain]
        return cls([r.name for r in chain], *(np.array([getattr(r, c) for r in chain]) for c in ("at_least", "above", "below")), np.array(fall), [r.tag for r in chain])


@dataclass
class Bars:
    """Rows of a series."""

    time: np.ndarray
    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    holds: np.ndarray
    enter: np.ndarray
    tag: list[str | None]


@dataclass
class Trade:
    open_time: int
    open_rate: float
    tag: str | None
    top: float = -np.inf
    stop: float = -np.inf

    def run(self, bars: Bars, a: int, b: int, bounds: Bounds) -> tuple[int, float, str] | None:
        """(row, rate, reason) of the first exit in rows a to b; what they leave is kept otherwise."""
        close = bars.close[a:b]
        profit = close / self.open_rate - 1
        top = np.maximum(self.top, np.maximum.accumulate(bars.high[a:b]))
        distance = np.full(b - a, np.nan)
        for least, far in reversed(STOP_TIERS):
            distance[profit > least] = far
        set_by = np.where(np.isnan(distance), -np.inf, close * (1 - distance))
        stop = np.maximum.accumulate(np.concatenate([[max(self.stop, self.open_rate * (1 + BASE_STOP))], set_by]))
        stopped = bars.low[a:b] <= stop[:-1]
        age = (bars.time[a:b] - self.open_time) / 60_000
        wanted = np.full(b - a, np.inf)
        for minutes, share in reversed(TAKE_TIERS):
            wanted[age >= minutes] = share
        taken = profit >= wanted
        reason = np.full(b - a, -1)
        there = bars.holds[a:b]
        for k in np.flatnonzero([bool((there >> k & 1).any()) and tag in (None, self.tag) for k, tag in enumerate(bounds.tags)])[::-1].tolist():
            found = (there >> k & 1 == 1) & (profit >= bounds.at_least[k]) & (profit > bounds.above[k]) & (profit < bounds.below[k])
            if bounds.fall[k] > -np.inf:
                found &= top / self.open_rate - 1 > profit + bounds.fall[k]
            reason[found] = k
        ends = np.flatnonzero(stopped | taken | (reason >= 0))
        if not len(ends):
            self.top, self.stop = float(top[-1]), float(stop[-1])
            return None
        k = int(ends[0])
        if stopped[k]:
            return a + k, float(stop[k]), STOP
        return a + k, float(close[k]), f"{bounds.names[reason[k]]}( {self.tag or 'empty'})" if reason[k] >= 0 else TAKE


class Series:
    """What is carried along a series: an open trade, or the tag of a signal of the last bar."""

    def __init__(self, bounds: Bounds):
        self.bounds, self.trade, self.signal, self.trades = bounds, None, None, 0

    def run(self, bars: Bars) -> Iterator[tuple]:
        """(trade_id, open_time, close_time, open_rate, close_rate, buy_tag, exit_reason) of the trades that these bars end."""
        at, n = 0, len(bars.time)
        signals = np.flatnonzero(bars.enter)
        while at < n:
            if self.trade is None and self.signal is None:
                k = int(np.searchsorted(signals, at))
                if k == len(signals):
                    return
                at, self.signal = int(signals[k]) + 1, (bars.tag[signals[k]] or None,)
                continue
            if self.trade is None:
                (tag,), self.signal = self.signal, None
                if not bars.open[at] > 0:  # nothing opens; this bar may signal again
                    self.signal = (bars.tag[at] or None,) if bars.enter[at] else None
                    at += 1
                    continue
                self.trade = Trade(int(bars.time[at]), float(bars.open[at]), tag)
            size, found = FIRST_RUN, None
            while at < n and found is None:
                end = min(n, at + size)
                found = self.trade.run(bars, at, end, self.bounds)
                at, size = end, 2 * size
            if found is not None:
                row, rate, why = found
                self.trades += 1
                yield self.trades, self.trade.open_time, int(bars.time[row]), self.trade.open_rate, rate, self.trade.tag, why
                self.trade = None
                self.signal = (bars.tag[row] or None,) if bars.enter[row] else None
                at = row + 1


COLUMNS = ["time", "open", "high", "low", "close", "holds", "enter_long", "buy_tag"]
FOUND = "trade_id long, open_time long, close_time long, open_rate double, close_rate double, buy_tag string, exit_reason string"


def rule_trades(df: DataFrame, fee: float, stake: float, chain: list[rules.ExitRule] | None = None) -> DataFrame:
    """Closed trades of bars with features, ``buy_tag`` and ``enter_long``, each with the same stake."""
    chain = chain or rules.exit_rules()
    own = rules.with_bars_before(df).withColumn("holds", rules.held_rules()).select(*KEYS, *COLUMNS)
    return closed_trades(own, Bounds.of(chain), fee, stake)


def closed_trades(own: DataFrame, bounds: Bounds, fee: float, stake: float) -> DataFrame:
    """rule_trades of bars with KEYS and COLUMNS."""

    def run(batches):
        current, series = None, None
        for batch in batches:
            at = segments(batch, KEYS)
            x = {c: numbers(batch[c]) for c in ("open", "high", "low", "close")}
            time, holds = batch["time"].to_numpy(), batch["holds"].to_numpy()
            enter, tags = batch["enter_long"].fill_null(0).to_numpy(zero_copy_only=False) == 1, batch["buy_tag"]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                key = tuple(batch[k][a].as_py() for k in KEYS)
                if key != current:
                    current, series = key, Series(bounds)
                found = list(series.run(Bars(time[a:b], x["open"][a:b], x["high"][a:b], x["low"][a:b], x["close"][a:b], holds[a:b], enter[a:b], tags.slice(a, b - a).to_pylist())))
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string()]
                    columns = [pa.array([v] * len(found), pa.string()) for v in key] + [pa.array(v, kind) for v, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, *(c.split()[0] for c in FOUND.split(", "))])

    found = own.repartition(*KEYS).sortWithinPartitions(*KEYS, "time").mapInArrow(run, f"symbol string, level string, {FOUND}")
    ratio = (1 - fee) * (1 - fee) * F.col("close_rate") / F.col("open_rate") - 1
    return found.withColumn("profit_ratio", ratio).withColumn("profit_abs", stake * F.col("profit_ratio"))
