"""Recurrences along a series: averages that depend on their own last value, all in one pass.

The rows of a series are brought together and sorted once; a task then goes through them batch by
batch and keeps nothing but the last value of each recurrence, so a series of any length takes
bounded memory and nothing is forgotten. Within a batch a linear recurrence s_i = q * s_(i-1) + b_i is
a scaled prefix sum over short chunks, in numpy, with the chunks' last values carried on. A step may
read the result of a step before it, so nested averages need no further pass. Warm-up values are
null, never NaN.

A long series doesn't have to be one task: tables over ``SPLIT_BYTES`` (as Spark estimates them) are dealt by
series and stretch of time. Over a stretch the values that the steps carry change by an affine map, since all of them are linear once warmed
up, nested ones in the values of those that they read. So each stretch is first reduced to its map, and to the few
bars that a series just begun would need to warm up; the maps of a series are then applied one after the other, a row for each stretch; and
each stretch is gone through again from the values that it begins with. Both passes read the same shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.build import LEVELS

#: Bars of a chunk: the powers of q over it stay within double precision's range.
CHUNK = 128


@dataclass(frozen=True)
class Step:
    """A recurrence over column x (of the table, or of a step before).

    ema: alpha = 2 / (n + 1), seeded with the first value, null for the first n - 1 values and for n = 0.
    wilder: seeded with the mean of the first n values, then s + (x - s) / n, null before the seed.
    linear: q * s + x, null before the first value.
    trail: the line that follows one of two ratcheting bands, x the average and q times wide their distance from it; 0 for the first n bars.
    max, min, mean, deviation, weighted: of the last n values: extremes, mean, mean distance from the mean, mean with weights 1 to n; null unless all n are there.

    Values may begin with nulls; later ones count as 0 (trail: as no number, which fails every comparison)."""

    out: str
    kind: str
    x: str
    n: int = 0
    q: float = 0.0
    wide: str = ""

    @property
    def reads(self) -> list[str]:
        return [self.x, self.wide] if self.wide else [self.x]


def run_linear(b: np.ndarray, q: float, s: float) -> np.ndarray:
    """s_i = q * s_(i-1) + b_i for all i, s before the first."""
    if q == 0 or not len(b):
        return b
    chunks = -(-len(b) // CHUNK)
    padded = np.zeros(chunks * CHUNK)
    padded[: len(b)] = b
    decay = q ** np.arange(CHUNK)
    part = np.cumsum(padded.reshape(chunks, CHUNK) / decay, axis=1) * decay
    carry, whole = np.empty(chunks), q**CHUNK
    for k, last in enumerate(part[:, -1].tolist()):
        carry[k] = s
        s = whole * s + last
    return (part + carry[:, None] * (decay * q)).ravel()[: len(b)]


class Linear:
    """The state of one ema, wilder or linear step along a series."""

    def __init__(self, step: Step):
        self.step, self.seen, self.sum, self.last = step, 0, 0.0, 0.0
        n = step.n
        self.q = {"ema": 1 - 2 / (n + 1), "wilder": 1 - 1 / max(1, n), "linear": step.q}[step.kind]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        step, there = self.step, ~np.isnan(x)
        place = self.seen + np.cumsum(there)
        b = np.where(there, x, 0.0)
        if step.kind == "ema":
            b = np.where(place == 1, b, b * (1 - self.q))
            shown = (place >= max(1, step.n)) & (step.n > 0)
        elif step.kind == "wilder":
            early = place < step.n
            at = int(np.argmax(place == step.n)) if step.n > self.seen and (place == step.n).any() else -1
            first = self.sum + b[: at + 1].sum() if at >= 0 else 0.0
            self.sum += b[early].sum()
            b = np.where(early, 0.0, b / step.n)
            if at >= 0:
                b[at] = first / step.n
            shown = ~early
        else:
            shown = place >= 1
        value = run_linear(b, self.q, self.last)
        if len(x):
            self.seen, self.last = int(place[-1]), float(value[-1])
        return np.where(shown, value, np.nan)


class Trail:
    """The state of a trail step: both bands, the one that is followed, and the average before."""

    def __init__(self, step: Step):
        self.n, self.times, self.bar, self.top, self.bottom, self.on_top, self.before = step.n, step.q, 0, 0.0, 0.0, True, np.nan

    def __call__(self, average: np.ndarray, wide: np.ndarray) -> np.ndarray:
        line = np.zeros(len(average))
        for k, (x, w) in enumerate(zip(average.tolist(), (wide * self.times).tolist(), strict=True)):
            if self.bar >= self.n:
                if x + w < self.top or self.before > self.top:
                    self.top = x + w
                if x - w > self.bottom or self.before < self.bottom:
                    self.bottom = x - w
                self.on_top = x <= self.top if self.on_top else not x >= self.bottom
                line[k] = self.top if self.on_top else self.bottom
            self.bar, self.before = self.bar + 1, x
        return line


def extremes(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """of (maximum or minimum) of each n values in a row: the end of one block of n and the beginning of the next, whatever n."""
    blocks = -(-len(x) // n)
    padded = np.full(blocks * n, np.nan)
    padded[: len(x)] = x
    own = padded.reshape(blocks, n)
    ahead = of.accumulate(own, axis=1).ravel()
    back = of.accumulate(own[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[: len(x) - n + 1], ahead[n - 1 : len(x)])


#: Values that are laid out at once as frames.
LAID_OUT = 1 << 18


class Frame:
    """The state of a step over the last n values."""

    def __init__(self, step: Step):
        self.step, self.before = step, np.zeros(0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n, every = self.step.n, np.concatenate([self.before, x])
        self.before = every[len(every) - min(len(every), n - 1) :]
        out = np.full(len(every), np.nan)
        if len(every) >= n:
            out[n - 1 :] = self.of(every, n)
        return out[len(every) - len(x) :]

    def of(self, x: np.ndarray, n: int) -> np.ndarray:
        kind = self.step.kind
        if kind in ("max", "min"):
            return extremes(x, n, np.maximum if kind == "max" else np.minimum)
        if kind == "weighted":
            return np.convolve(x, np.arange(n, 0, -1.0), "valid") / (n * (n + 1) / 2)
        frames, out = np.lib.stride_tricks.sliding_window_view(x, n), []
        for a in range(0, len(frames), max(1, LAID_OUT // n)):
            own = frames[a : a + max(1, LAID_OUT // n)]
            mean = own.mean(axis=1)
            out.append(mean if kind == "mean" else np.abs(own - mean[:, None]).mean(axis=1))
        return np.concatenate(out)


def numbers(column: pa.Array) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)


def segments(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for key in keys:
        codes = batch[key].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), batch.num_rows)


def made(steps: list[Step], states: dict[str, Linear | Trail | Frame], x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The columns of the steps over a run of rows with source columns x; states go on to its end."""
    found: dict[str, np.ndarray] = {}
    for s in steps:
        found[s.out] = states[s.out](*((found if c in found else x)[c] for c in s.reads))
    return found


LINEAR = ("ema", "wilder", "linear")


def begun(steps: list[Step]) -> dict[str, Linear | Trail | Frame]:
    return {s.out: Linear(s) if s.kind in LINEAR else Trail(s) if s.kind == "trail" else Frame(s) for s in steps}


#: Size of a table (Spark's estimate) from which series are split in time, and bars of a stretch.
SPLIT_BYTES, STRETCH = 1 << 30, 1 << 16


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the sizes of the tables that df reads; those of which it knows nothing count as empty."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < (1 << 63) - 1)


def recurrences(df: DataFrame, keys: list[str], steps: list[Step], order: str = "time", split: bool | None = None) -> DataFrame:
    """df with a column for each step; series split in time or not, if split doesn't leave it to the table's size.

    Only series with a level, in order of their time, and only ema, wilder and linear steps can be split."""
    outs = [s.out for s in steps]
    rest = df.drop(*outs)
    sources = sorted({c for s in steps for c in s.reads} - set(outs))
    schema = T.StructType([*rest.schema.fields, *(T.StructField(c, T.DoubleType()) for c in outs)])
    able = "level" in keys and order == "time" and all(s.kind in LINEAR for s in steps)
    if able and (estimated_bytes(rest) >= SPLIT_BYTES if split is None else split):
        return _split(rest, keys, steps, sources, schema)

    def run(batches):
        current, states = None, {}
        for batch in batches:
            bounds = segments(batch, keys)
            x = {c: numbers(batch[c]) for c in sources}
            found = {c: np.empty(batch.num_rows) for c in outs}
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                key = tuple(batch[k][a].as_py() for k in keys)
                if key != current:
                    current, states = key, begun(steps)
                for c, values in made(steps, states, {c: v[a:b] for c, v in x.items()}).items():
                    found[c][a:b] = values
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[c], pa.float64(), from_pandas=True) for c in outs)], names=[*batch.schema.names, *outs])

    return rest.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def affine(steps: list[Step], x: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, vector) of what n rows make of the steps' last values, once all are warmed up."""
    at = {s.out: k for k, s in enumerate(steps)}

    def run(last: np.ndarray, own: list[Step], sources: dict[str, np.ndarray]) -> np.ndarray:
        states = begun(own)
        for s in own:
            states[s.out].seen, states[s.out].last = 1 << 40, last[at[s.out]]
        made(own, states, sources)
        return np.array([states[s.out].last for s in own])

    vector = run(np.zeros(len(steps)), steps, x)
    matrix = np.zeros((len(steps), len(steps)))
    nothing = np.zeros(n)
    for s in steps:
        after = {s.out}  # the step and those that read it, directly or not
        for t in steps:
            if t.x in after:
                after.add(t.out)
        own = [t for t in steps if t.out in after]
        if len(own) == 1:
            matrix[at[s.out], at[s.out]] = begun(own)[s.out].q ** n
        else:
            unit = np.zeros(len(steps))
            unit[at[s.out]] = 1.0
            sources = {c: nothing for t in own for c in t.reads if c not in after}
            matrix[[at[t.out] for t in own], at[s.out]] = run(unit, own, sources)
    return matrix, vector


def warmed_at(steps: list[Step], x: dict[str, np.ndarray], n: int) -> int:
    """How many rows a series that begins with these needs until all steps are warmed up; n if they don't suffice."""
    found = made(steps, begun(steps), x)
    shown = [np.flatnonzero(~np.isnan(found[s.out]))[:1] for s in steps if s.kind != "ema" or s.n > 0]
    return n if any(not len(k) for k in shown) else max((int(k[0]) + 1 for k in shown), default=n)


def _split(rest: DataFrame, keys: list[str], steps: list[Step], sources: list[str], schema: T.StructType) -> DataFrame:
    """recurrences of series that are dealt by stretches of time."""
    length = F.create_map(*[F.lit(v) for name, ms, _ in LEVELS for v in (name, ms or 30 * 86_400_000)])
    stretch = F.floor(F.col("time") / (F.coalesce(F.try_element_at(length, F.col("level")), F.lit(86_400_000)) * STRETCH))
    rows = rest.withColumn("_stretch", stretch)
    own, outs = [*keys, "_stretch"], [s.out for s in steps]
    k, w, columns = len(steps), len(sources), rest.columns

    def in_order(rows: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray]]:
        rows = rows.take(pa.array(np.argsort(rows["time"].to_numpy(), kind="stable")))
        return rows, {c: numbers(rows[c].combine_chunks()) for c in sources}

    def reduced(rows: pa.Table) -> pa.Table:
        rows, x = in_order(rows)
        n = rows.num_rows
        head = warmed_at(steps, x, n)
        whole, tail = affine(steps, x, n), affine(steps, {c: v[head:] for c, v in x.items()}, n - head)
        numbers_ = np.concatenate([*(m.ravel() for m in (*whole, *tail)), *(x[c][:head] for c in sources)])
        return pa.table({**{c: rows[c].slice(0, 1) for c in own}, "held": pa.array([numbers_.tolist()], pa.list_(pa.float64()))})

    def carried(stretches: pa.Table) -> pa.Table:
        """What each stretch of a series begins with: values seen, sum and last value of each step."""
        stretches = stretches.take(pa.array(np.argsort(stretches["_stretch"].to_numpy(), kind="stable")))
        states, begins = begun(steps), []
        for held in stretches["held"]:
            held = held.values.to_numpy()
            begins.append([v for s in steps for v in (float(states[s.out].seen), states[s.out].sum, states[s.out].last)])
            size = k * k + k
            maps, heads = held[: 2 * size].reshape(2, size), held[2 * size :].reshape(w, -1)
            change = maps[0]
            if any(states[s.out].seen < max(1, s.n) for s in steps):
                made(steps, states, {c: heads[j] for j, c in enumerate(sources)})
                change = maps[1]
            last = change[: k * k].reshape(k, k) @ np.array([states[s.out].last for s in steps]) + change[k * k :]
            for s, v in zip(steps, last.tolist(), strict=True):
                states[s.out].last = v
        return pa.table({**{c: stretches[c] for c in own}, "begin": pa.array(begins, pa.list_(pa.float64()))})

    def gone_through(rows: pa.Table, begin: pa.Table) -> pa.Table:
        rows, x = in_order(rows)
        states, values = begun(steps), begin["begin"][0].values.to_numpy().reshape(k, 3)
        for s, (seen, total, last) in zip(steps, values.tolist(), strict=True):
            states[s.out].seen, states[s.out].sum, states[s.out].last = int(seen), total, last
        found = made(steps, states, x)
        return pa.table({**{c: rows[c] for c in columns}, **{c: pa.array(found[c], pa.float64(), from_pandas=True) for c in outs}})

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema)
    maps = rows.groupBy(*own).applyInArrow(reduced, f"{named}, held array<double>")
    begins = maps.groupBy(*keys).applyInArrow(carried, f"{named}, begin array<double>")
    return rows.groupBy(*own).cogroup(begins.groupBy(*own)).applyInArrow(gone_through, schema)


def linear_scan(df: DataFrame, keys: list[str], order: str, q: float, b: Column, out: str) -> DataFrame:
    return recurrences(df.withColumn("_b", b.cast("double")), keys, [Step(out, "linear", "_b", q=q)], order).drop("_b")


def ema(df: DataFrame, col: str, period: int, out: str, keys: list[str], order: str = "time", split: bool | None = None) -> DataFrame:
    return recurrences(df, keys, [Step(out, "ema", col, period)], order, split)


def wilder(df: DataFrame, col: str, period: int, out: str, keys: list[str], order: str = "time") -> DataFrame:
    return recurrences(df, keys, [Step(out, "wilder", col, period)], order)


#: Periods of a grid that one task makes.
PERIODS = 16


def ema_grid(df: DataFrame, p_min: int, p_max: int, keys: list[str], order: str = "time", col: str = "close") -> DataFrame:
    """A row for each bar and each period from p_min to p_max, with its ema; a series is dealt to a task for each PERIODS periods."""
    starts = F.explode(F.sequence(F.lit(p_min), F.lit(p_max), F.lit(PERIODS)))
    own, names = [*keys, "_from"], [*df.columns, "period", "ema"]

    def run(batches):
        current, state = None, {}
        for batch in batches:
            bounds, x = segments(batch, own), numbers(batch[col])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                key = tuple(batch[k][a].as_py() for k in own)
                if key != current:
                    current, state = key, {p: Linear(Step("", "ema", col, p)) for p in range(key[-1], min(p_max + 1, key[-1] + PERIODS))}
                rows = batch.slice(a, b - a)
                for p, step in state.items():
                    yield pa.RecordBatch.from_arrays([*rows.drop_columns(["_from"]).columns, pa.array(np.full(b - a, p, np.int32)), pa.array(step(x[a:b]), pa.float64(), from_pandas=True)], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField("period", T.IntegerType()), T.StructField("ema", T.DoubleType())])
    if p_max < p_min:
        return df.withColumns({"period": F.lit(None).cast("int"), "ema": F.lit(None).cast("double")}).limit(0)
    return df.withColumn("_from", starts).repartition(*own).sortWithinPartitions(*own, order).mapInArrow(run, schema)
