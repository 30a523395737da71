"""Golden cases and plain loops for the candle operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.scan import ema, ema_grid
from tickloom.operators import backtest as bt
from tickloom.operators import build, joins, quality, rules
from tickloom.sources import candles as src
from tickloom.streaming import ingest

KEYS = ["symbol", "level"]


def series(spark, closes, opens=None, times=None, symbol="A-B"):
    opens, times = opens or closes, times or range(len(closes))
    rows = [(symbol, "1h", int(t), float(o), float(max(o, c) + 1), float(min(o, c) - 1), float(c), float(10 + k % 7)) for k, (t, o, c) in enumerate(zip(times, opens, closes))]
    return spark.createDataFrame(rows, src.SCHEMA)


def walk(n, seed=1):
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= 1 + rng.uniform(-0.02, 0.02)
        out.append(round(x, 2))
    return out


def column(df, c, *order):
    return [r[c] for r in df.orderBy(*(order or ("time",))).collect()]


def run(spark, opens, closes, signals, fee=0.0015, capital=1000.0):
    d = series(spark, closes, opens).withColumn("s", F.element_at(F.array(*[F.lit(s).cast("int") for s in signals]), (F.col("time") + 1).cast("int")))
    return bt.equity(bt.growth(bt.positions(d, F.col("s"), KEYS), fee, KEYS), capital, KEYS)


def test_next_bar_delay_and_fees(spark):
    assert column(run(spark, [100, 100, 200], [100, 100, 100], [None, 1, 1]), "value")[-1] == pytest.approx(499.25)
    assert column(run(spark, [100] * 6, [100] * 6, [None, 1, 1, 1, 0, 0]), "value")[-1] == pytest.approx(1000 * (1 - 0.0015) ** 2)
    assert column(run(spark, [100, 100, 200, 100], [100, 100, 200, 100], [None, 1, None, None]), "value")[-1] == pytest.approx(499.25)


def test_signals(spark):
    d = spark.createDataFrame([(0, None, None), (1, 2.0, 1.0), (2, 1.0, 2.0), (3, 1.0, 1.0)], "k int, f double, s double")
    assert [r[0] for r in d.orderBy("k").select(bt.double_ema_signal(F.col("f"), F.col("s"))).collect()] == [None, 1, 0, None]
    d = spark.createDataFrame([(0, 100.0, 100.0), (1, 110.0, 105.0), (2, 100.0, 105.0)], "k int, c double, e double")
    assert [r[0] for r in d.orderBy("k").select(bt.price_vs_ema_signal(F.col("c"), F.col("e"))).collect()] == [None, 1, 0]


def test_metrics(spark):
    def dd(values):
        d = spark.createDataFrame([(float(v), float(max(values[: k + 1]))) for k, v in enumerate(values)], "value double, peak double")
        return d.agg(bt.max_drawdown()).first()[0]

    assert (dd([1, 2, 3]), dd([100, 50, 75, 25]), dd([])) == (0, 75, 0)
    sharpe = lambda r, rf=0.0: spark.createDataFrame([(float(x),) for x in r], "r double").agg(bt.sharpe("r", 252, rf)).first()[0]
    assert sharpe([0.05]) == sharpe([0.0] * 50) == sharpe([0.01] * 4) == 0 and abs(sharpe([0.01, -0.01])) < 1e-9
    assert sharpe([0.02, 0, 0.02, 0]) == pytest.approx(13.7477, abs=0.01) and sharpe([0.02, 0, 0.02, 0], 0.005) < 13.7


def test_grids_and_ranking(spark):
    assert [tuple(r) for r in bt.pair_grid(spark, 5, 6, 7).orderBy("fast", "slow").collect()] == [(5, 6), (5, 7), (6, 7)]
    assert bt.pair_grid(spark, 5, 6, 600).count() == 177_310
    assert column(bt.period_grid(spark, 5, 8), "period", "period") == [5, 6, 7, 8]
    rows = [("a", "1h", 10, 20, 5.0, 1.0), ("a", "1h", 12, 24, 5.0, 1.0), ("b", "1h", 1, 2, 1000.0, 0.5), ("b", "1h", 1, 3, 900.0, 1.0), ("c", "1h", 1, 2, 1.0, -10.0), ("c", "1h", 1, 3, 9.0, float("nan"))]
    best = bt.rank(spark.createDataFrame(rows, "symbol string, level string, fast int, slow int, final_value double, sharpe double"), ["fast", "slow"], 1)
    assert {r["symbol"]: (r["fast"], r["slow"]) for r in best.collect()} == {"a": (10, 20), "b": (1, 3), "c": (1, 2)}


def test_ema(spark):
    assert column(ema(series(spark, [1, 2, 3]), "close", 1, "e", KEYS), "e") == [1, 2, 3]
    assert column(ema(series(spark, [1, 2, 3]), "close", 0, "e", KEYS), "e") == [None] * 3
    closes = walk(700)
    for p in (3, 26, 200):
        want, s = [], None
        for k, x in enumerate(closes):
            s = x if s is None else x * 2 / (p + 1) + s * (1 - 2 / (p + 1))
            want.append(s if k >= p - 1 else None)
        got = column(ema(series(spark, closes), "close", p, "e", KEYS), "e")
        assert all((a is None) == (b is None) and (a is None or abs(a / b - 1) < 1e-12) for a, b in zip(got, want))
    grid = ema_grid(series(spark, [1, 2, 3]), 2, 4, KEYS)
    assert {r["period"] for r in grid.collect()} == {2, 3, 4}


def test_adx_and_t3_against_loops(spark):
    closes = walk(120, 3)
    d = series(spark, closes)
    rows = d.orderBy("time").collect()

    def wilder(x, n):
        out, s, seen = [], None, []
        for v in x:
            if v is None:
                out.append(None)
                continue
            seen.append(v)
            s = sum(seen) / n if len(seen) == n else None if len(seen) < n else s + (v - s) / n
            out.append(s)
        return out

    tr, up, dn = [None], [None], [None]
    for a, b in zip(rows, rows[1:]):
        u, v = b["high"] - a["high"], a["low"] - b["low"]
        tr.append(max(b["high"] - b["low"], abs(b["high"] - a["close"]), abs(b["low"] - a["close"])))
        up.append(u if u > v and u > 0 else 0.0)
        dn.append(v if v > u and v > 0 else 0.0)
    w = [wilder(x, 14) for x in (tr, up, dn)]
    dx = [None if t is None else 100 * abs(p - m) / (p + m) if p + m else 0.0 for t, p, m in zip(*w)]
    want = wilder(dx, 14)
    got = column(ind.adx(d), "adx")
    assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)) for a, b in zip(got, want))

    def plain_ema(x, p):
        out, s, n = [], None, 0
        for v in x:
            if v is not None:
                s, n = v if s is None else v * 2 / (p + 1) + s * (1 - 2 / (p + 1)), n + 1
            out.append(s if n >= p else None)
        return out

    e = [closes]
    for _ in range(6):
        e.append(plain_ema(e[-1], 5))
    b = 0.7
    c = -(b**3), 3 * b**2 + 3 * b**3, -6 * b**2 - 3 * b - 3 * b**3, 1 + 3 * b + b**3 + 3 * b**2
    want = [None if x6 is None else c[0] * x6 + c[1] * x5 + c[2] * x4 + c[3] * x3 for x3, x4, x5, x6 in zip(*e[3:])]
    got = column(ind.t3(d), "t3")
    assert all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(got, want))


def test_rsi_of_a_flat_series_is_50(spark):
    assert column(ind.rsi(series(spark, [5] * 20), 14), "rsi_14")[-1] == 50


def test_no_look_ahead(spark):
    closes = walk(60, 5)
    d, cut = series(spark, closes, times=[k * 3_600_000 for k in range(60)]), series(spark, closes[:40], times=[k * 3_600_000 for k in range(40)])
    merge = lambda x: column(joins.asof_merge(x, build.rollup(x, "4h"), ["close"], "_4h", 3_600_000, 4 * 3_600_000), "close_4h")
    assert merge(d)[:40] == merge(cut) and merge(d)[:5] == [None, None, None, closes[3], closes[3]]


def test_quality(spark):
    raw = spark.createDataFrame([("a", "1h", t, k) for k, t in enumerate([3, 1, 2, 1])] + [("b", "1h", 1, 0)], "symbol string, level string, time long, arrival long")
    assert [(r["time"], r["arrival"]) for r in quality.normalize(raw, "arrival").where("symbol = 'a'").orderBy("time").collect()] == [(1, 1), (2, 2), (3, 0)]
    report = {r["symbol"]: tuple(r)[2:] for r in quality.normalize_report(raw, "arrival").collect()}
    assert report == {"a": (True, 1, True), "b": (False, 0, False)}
    assert [(r["previous"], r["time"]) for r in quality.check_increasing(raw, "arrival").orderBy("time", "previous").collect()] == [(2, 1), (3, 1)]
    check = lambda times: tuple(quality.interval_check(series(spark, [1] * len(times), times=times)).first())[2:]
    assert (check([0, 100, 200]), check([0, 100, 500, 600]), check([7])) == ((True, 100), (False, 400), (True, 0))


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/candles"
    d = series(spark, walk(100))
    src.write_candles(d, path)
    src.write_candles(series(spark, [1, 2], symbol="C-D"), path)
    assert src.read_candles(spark, path).groupBy("symbol").count().orderBy("symbol").collect() == [("A-B", 100), ("C-D", 2)]
    assert column(src.select_series(src.read_candles(spark, path), "a-b", "1h"), "close") == walk(100)
    with pytest.raises(ValueError):
        src.select_series(d, "AB", "1h")
    d.drop("low").write.parquet(f"{tmp_path}/bad")
    with pytest.raises(src.SchemaError):
        src.read_candles(spark, f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        src.last_time(d.limit(0))
    assert column(src.scan_range(d, 10, 20), "time") == list(range(10, 20)) and column(src.scan_range(d, "10", 20, inclusive=True), "time")[-1] == 20
    assert src.time_ms("2019-01-01") == 1546300800000
    (tmp_path / "a.json").write_text('[{"time":3,"open":1,"high":1,"low":1,"close":1},{"time":1,"open":2,"high":2,"low":2,"close":2},{"time":1,"open":9,"high":9,"low":9,"close":9}]')
    assert src.migrate_json(spark, f"{tmp_path}/a.json", "E-F", "1h", path) and not src.migrate_json(spark, f"{tmp_path}/a.json", "E-F", "1h", path)
    own = src.read_candles(spark, path).where("symbol = 'E-F'")
    assert [(r["time"], r["close"]) for r in own.orderBy("time").collect()] == [(1, 2.0), (3, 1.0)]


def test_results_file(spark, tmp_path):
    best = spark.createDataFrame([(1.5, 2.0, 0.25, 5, 10)], "final_value double, max_dd double, sharpe double, fast int, slow int")
    for _ in range(2):
        src.append_result(src.result_record(best, 'a,"b"', "f64", "double_ema", bt.DoubleEma().text(), 7), f"{tmp_path}/r")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/r").collect()
    assert len(back) == 2 and back[0]["Filename"] == 'a,"b"' and back[0]["Params"] == "fast=5,slow=10" and back[0]["portfolio_val"] == "1.500"


def test_ingest(spark, tmp_path):
    landing, table = f"{tmp_path}/landing", f"{tmp_path}/table"
    payload = lambda rows: "[" + ",".join(f'[{t},"{p}","{p}","{p}","{p}"]' for t, p in rows) + "]"
    for k, rows in enumerate(([(0, 1), (3_600_000, 2)], [(3_600_000, 9), (7_200_000, 3), (5, "x")])):
        spark.createDataFrame([("A-B", "1h", payload(rows))], ingest.LANDED).write.mode("append").parquet(landing)
        ingest.ingest_stream(spark, landing, table, f"{tmp_path}/checkpoint").awaitTermination()
        assert column(src.read_candles(spark, table), "close") == ([1, 2], [1, 2, 3])[k]
    assert spark.read.parquet(f"{table}-bad").count() == 1


def test_ingest_loses_nothing(spark, tmp_path):
    """A bad row of another series, two bars of one time, and a table that can't be read."""
    landing, table = f"{tmp_path}/landing", f"{tmp_path}/table"
    src.write_candles(series(spark, [1.0 + k for k in range(10)], times=[k * 3_600_000 for k in range(10)]).unionByName(series(spark, [5.0], symbol="C-D")), table)
    bar = lambda t, p: f'["{t}","{p}","{p}","{p}","{p}"]'
    rows = [("A-B", "1h", f"[{bar(36_000_000, 7)},{bar(36_000_000, 8)},{bar(36_000_000, 6)}]"), ("C-D", "1h", f"[{bar('x', 1)}]"), ("A-B", "1h", f"[{bar(36_000_000, 1)}]")]
    spark.createDataFrame(rows, ingest.LANDED).coalesce(1).write.parquet(landing)
    ingest.ingest_stream(spark, landing, table, f"{tmp_path}/checkpoint").awaitTermination()
    got = src.read_candles(spark, table)
    assert column(got.where("symbol = 'A-B'"), "close") == [*range(1, 11), 7] and column(got.where("symbol = 'C-D'"), "close") == [5]
    bad = tmp_path / "table" / "symbol=A-B" / "level=1h" / "period=1970"
    for f in bad.glob("*.parquet"):
        f.write_bytes(b"not a table at all")
    spark.createDataFrame([("A-B", "1h", f"[{bar(40_000_000, 2)}]")], ingest.LANDED).write.mode("append").parquet(landing)
    with pytest.raises(Exception):
        ingest.ingest_stream(spark, landing, table, f"{tmp_path}/checkpoint").awaitTermination()
    assert all(f.read_bytes() == b"not a table at all" for f in bad.glob("*.parquet")) and len(list(bad.glob("*.parquet"))) >= 1
    (tmp_path / "a.json").write_text('[{"time": 1, "open": 1, "high": 1, "low": 1, "close": 4}]')
    assert src.migrate_archives(spark, {("A-B", "1h"): f"{tmp_path}/a.json", ("C-D", "1h"): f"{tmp_path}/a.json"}, table) == {("A-B", "1h"): True, ("C-D", "1h"): False}
    assert column(src.read_candles(spark, table).where("symbol = 'A-B'"), "close") == [4]


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_merge_takes_the_first_arrival(spark, parts):
    new = spark.createDataFrame([("A-B", "1h", 0, float(k), float(k), float(k), float(k), None, (k * 5) % 8) for k in range(8)], "symbol string, level string, time long, open double, high double, low double, close double, volume double, at int")
    old = spark.createDataFrame([], src.SCHEMA)
    assert column(quality.merge_candles(old, new.repartition(parts), "at"), "close") == [0.0] and len({column(quality.merge_candles(old, new.repartition(parts)), "close")[0]}) == 1


@pytest.mark.parametrize("level", ["3m", "30m", "2h", "6h", "12h", "3d", "1w"])
def test_candle_stream_levels(spark, tmp_path, level):
    """Bars of a stream are those of the table, up to the last."""
    rows = [("a", k * 3_600_000 * 7, k, float(k), 1.0) for k in range(120)]
    d = spark.createDataFrame(rows, "symbol string, ms long, seq long, price double, volume double").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    d.write.parquet(f"{tmp_path}/ticks")
    q = ingest.candle_stream(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/ticks"), level, "0 seconds").writeStream.format("memory").queryName(f"bars_{level}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["time"]: (r["open"], r["close"]) for r in spark.table(f"bars_{level}").collect()}
    want = {r["time"]: (r["open"], r["close"]) for r in build.build_candles(d, level).collect()}
    assert got and got.items() <= want.items() and len(got) >= len(want) - 1


def test_candle_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 0{h}:{m:02d}:00", h * 100 + m, float(h * 60 + m), 1.0) for h in range(4) for m in (1, 30, 59)]
    spark.createDataFrame(rows, "symbol string, ts string, seq long, price double, volume double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/ticks")
    stream = spark.readStream.schema("symbol string, ts timestamp, seq long, price double, volume double").parquet(f"{tmp_path}/ticks")
    q = ingest.candle_stream(stream, "1h", "0 seconds").writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("bars").orderBy("time").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in got][:3] == [(1, 59, 3), (61, 119, 3), (121, 179, 3)]


@pytest.mark.parametrize("n", [2, 3, 40, 400])
def test_array_and_relational_scores(spark, n):
    """Both layouts score alike, ties of averages and flat stretches included."""
    closes = walk(n, n)
    closes[5:12] = closes[5:6] * len(closes[5:12])
    d = series(spark, closes, [round(c * (1 + (k % 5 - 2) / 300), 2) for k, c in enumerate(closes)])
    d = d.unionByName(series(spark, walk(n, 9), symbol="C-D")).unionByName(series(spark, [50.0] * n, symbol="E-F"))
    for strategy in (bt.DoubleEma(1, 2, 9), bt.SingleEma(1, 7), bt.DoubleEma(pairs=[(3, 8), (2, 5)])):
        one = {tuple(r[c] for c in ("symbol", *strategy.params)): r for r in bt.backtest(d, strategy, "1h").collect()}
        two = {tuple(r[c] for c in ("symbol", *strategy.params)): r for r in bt.relational_scores(d, strategy, "1h", 0.0015, 1000.0).collect()}
        assert one.keys() == two.keys() and len(one) >= 6
        for k, r in one.items():
            assert r["bars"] == two[k]["bars"] == n
            for c in ("final_value", "max_dd", "sharpe"):
                assert r[c] == pytest.approx(two[k][c], rel=1e-9, abs=1e-9), (k, c)


def plain_run(opens, closes, follow, fee, capital, per_year):
    """(final value, drawdown, Sharpe ratio) bar by bar; follow says after each bar whether to hold."""
    import numpy as np

    opens, closes = np.array(opens, float), np.array(closes, float)
    cash, quantity, held, before = np.float64(capital), np.float64(0), False, capital
    values, returns = [cash], []
    with np.errstate(all="ignore"):
        for k in range(1, len(closes)):
            if follow[k - 1] and not held:
                quantity, cash, held = cash / opens[k] * (1 - fee), np.float64(0), True
            elif not follow[k - 1] and held:
                cash, quantity, held = quantity * opens[k] * (1 - fee), np.float64(0), False
            value = quantity * closes[k] if held else cash
            values.append(value)
            if before > 0:
                returns.append((value - before) / before)
            before = value
        peak, fall = values[0], 0.0
        for v in values:
            peak = v if v > peak else peak
            own = (peak - v) / peak if peak > 0 else 0.0
            fall = own if own > fall else fall
        sd = np.std(returns, ddof=1) if len(returns) > 1 else 0.0
    ratio = np.mean(returns) / sd * per_year**0.5 if np.isfinite(sd) and sd > 1e-15 else 0.0
    return float(values[-1]), fall * 100, float(ratio)


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-8, abs=1e-7)


@pytest.mark.parametrize("zero_closes, zero_opens", [((30, 31, 70), ()), ((), (40,)), ((12, 55), (56, 20)), ((79,), ()), (range(50, 80), (60,))])
def test_prices_of_zero_in_both_layouts(spark, recwarn, zero_closes, zero_opens):
    closes, n = walk(80, 3), 80
    opens = [round(c * (1 + (k % 5 - 2) / 300), 2) for k, c in enumerate(closes)]
    for k in zero_closes:
        closes[k] = 0.0
    for k in zero_opens:
        opens[k] = 0.0
    d = series(spark, closes, opens)
    strategy = bt.DoubleEma(1, 2, 9)
    one, two = ({(r["fast"], r["slow"]): r for r in x.collect()} for x in (bt.backtest(d, strategy, "1h"), bt.relational_scores(d, strategy, "1h", 0.0015, 1000.0)))
    import numpy as np

    for (pair, follow) in strategy.follow(np.array(closes), [p for t in strategy.tiles() for p in t]):
        want = plain_run(opens, closes, follow, 0.0015, 1000.0, 8760)
        for found in (one[pair], two[pair]):
            assert found["bars"] == n and all(same(found[c], x) for c, x in zip(("final_value", "max_dd", "sharpe"), want)), (pair, found, want)
    assert not [w for w in recwarn if issubclass(w.category, RuntimeWarning)]


def test_every_default_pair_is_in_a_tile():
    pairs = [p for t in bt.DoubleEma().tiles() for p in t]
    assert len(pairs) == len(set(pairs)) == 177_310 and max(map(len, bt.DoubleEma().tiles())) <= bt.TILE**2


def test_best_of_a_sweep_is_the_same_twice(spark):
    closes = [100 + 20 * math.sin(k / 30) for k in range(200)]
    d = series(spark, closes, [c + 0.5 for c in closes], [60_000 * k for k in range(200)])
    best = [bt.rank(bt.backtest(x, bt.DoubleEma(3, 4, 8), "1h"), ["fast", "slow"], 1).first() for x in (d, d.repartition(5))]
    assert best[0] == best[1]


def test_long_memory(spark):
    """An average over 50,000 bars of a series of 300,000 forgets nothing."""
    n, p = 300_000, 50_000
    d = spark.range(n).select(F.lit("A-B").alias("symbol"), F.lit("1m").alias("level"), F.col("id").alias("time"), (F.when(F.col("id") < 1000, 1e6).otherwise(1.0) + F.col("id") % 7).alias("close"))
    got = ema(d, "close", p, "e", KEYS).where(f"time in ({p - 2}, {p - 1}, {n - 1})").orderBy("time").collect()
    e, want = None, []
    for k in range(n):
        x = (1e6 if k < 1000 else 1.0) + k % 7
        e = x if e is None else e + 2 / (p + 1) * (x - e)
        want.append(e)
    assert got[0]["e"] is None and [r["e"] for r in got[1:]] == pytest.approx([want[p - 1], want[n - 1]], rel=1e-9)


NEUTRAL = dict(
    open=100.0, high=101.0, low=99.0, close=100.0, volume=100.0, rsi=50.0, rsi_fast=50.0, rsi_slow=50.0, rmi=50.0, cci=0.0, srsi_k=50.0, bb_delta=0.01, bb_width=0.05, closedelta=0.0, bb3_low=80.0, bb_low=85.0, bb_mid=100.0, bb_up=115.0,
    kc_low_28=80.0, kc_up_28=120.0, ewo=0.0, crsi=50.0, cti=0.0, r_14=-30.0, rocr_168_1h=1.0, bbh_low=80.0, bb_delta_cluc=1.0, ha_close=100.0, ha_closedelta=0.0, tail=1.0, fastk=50.0, fastd=50.0, adx=20.0, t3=100.0, t3_1h=100.0, bb_mid_1h=90.0,
    linreg_20=1.0, cti_1h=0.0, crsi_1h=50.0, pm=90.0, pmax_thresh=100.0, roc_1h=0.0, bb_width_1h=0.1, **{f"ema_{n}": 100.0 for n in (4, 8, 12, 13, 16, 20, 26, 50, 100, 200)}, **{f"sma_{n}": 100.0 for n in (15, 21, 28, 30, 75)},
    **{f"volume_mean_{n}": 100.0 for n in (4, 12, 24)}, ema_50_1h=100.0, ema_100_1h=100.0, ema_200_1h=100.0, moderi=False, safe_dump_1h=False,
)
RISING = {0: {"ema_200_1h": 103.0}, 12: {"ema_200_1h": 102.0}, 24: {"ema_200_1h": 101.0}}
#: what fires each rule at the last bar, by bars back
FIRES = {
    "bb": {0: dict(rmi=40.0, cci=-120.0, srsi_k=20.0, bb_delta=0.03, bb_width=0.1, closedelta=5.0, close=70.0)},
    "local_uptrend": {0: dict(ema_26=110.0, close=70.0, closedelta=5.0), 1: dict(ema_26=110.0)},
    "local_dip": {0: dict(ema_26=110.0, close=90.0, rsi=15.0, crsi=20.0, closedelta=5.0), 1: dict(ema_26=110.0)},
    "ewo": {0: dict(rsi_fast=40.0, close=90.0, rsi=20.0)},
    "ewo2": {**RISING, 0: dict(ema_200_1h=103.0, rsi_fast=40.0, close=90.0, ewo=5.0, rsi=30.0)},
    "r_deadfish": {0: dict(bb_width=0.4, close=90.0, volume_mean_12=200.0, cti=-0.5, r_14=-60.0)},
    "clucHA": {0: dict(bb_delta_cluc=10.0, ha_closedelta=5.0, ha_close=90.0), 1: dict(bbh_low=95.0)},
    "cofi": {0: dict(fastk=20.0, fastd=10.0, ewo=9.0, cti=-0.95, r_14=-90.0), 1: dict(fastk=10.0, fastd=10.0)},
    "gumbo": {0: dict(ewo=-10.0, bb_mid_1h=105.0, cti=-0.5, r_14=-60.0)},
    "sqzmom": {0: dict(bb_low=75.0, bb_up=125.0, linreg_20=-2.0, close=90.0, ewo=-5.0, r_14=-60.0), 1: dict(linreg_20=-3.0), 2: dict(linreg_20=-1.0)},
    "nfi_13": {0: dict(ema_50_1h=101.0, close=90.0, cti=-0.95, ewo=-6.0, cti_1h=-0.9)},
    "nfi_32": {0: dict(rsi_slow=40.0, rsi_fast=40.0, rsi=30.0, close=90.0, cti=-0.95)},
    "nfi_33": {0: dict(close=90.0, ewo=9.0, cti=-0.9, rsi=30.0, r_14=-99.0)},
    "nfi_38": {0: dict(pm=110.0, close=90.0, ewo=-5.0, cti=-0.96, r_14=-98.0)},
    "nfix_5": {**RISING, 0: dict(ema_200_1h=103.0, close=90.0, ewo=4.0, cti=-0.95, r_14=-98.0)},
    "nfix_39": {**RISING, 0: dict(ema_200_1h=103.0, bb_delta_cluc=10.0, closedelta=5.0, close=95.0), 1: dict(bbh_low=98.0)},
    "nfix_49": {0: dict(cti=-0.5, r_14=-85.0), 3: dict(ema_26=110.0, close=80.0, rsi=30.0, crsi=20.0), 9: dict(ema_26=110.0)},
    "nfi7_33": {0: dict(moderi=True, cti=-0.9, close=90.0, ewo=7.0, rsi=30.0)},
    "nfi7_37": {0: dict(pm=110.0, close=90.0, ewo=10.0, cti=-0.8, safe_dump_1h=True)},
}


def test_each_entry_rule_fires(spark):
    rows = []
    for tag, bars in FIRES.items():
        rows += [{"symbol": tag, "level": "1h", "time": k, **NEUTRAL, **bars.get(29 - k, {})} for k in range(30)]
    rows += [{"symbol": "none", "level": "1h", "time": k, **NEUTRAL} for k in range(30)] + [{"symbol": "null", "level": "1h", "time": 0, **dict.fromkeys(NEUTRAL)}]
    kinds = ", ".join(f"{c} {'boolean' if isinstance(v, bool) else 'double'}" for c, v in NEUTRAL.items())
    d = spark.createDataFrame([tuple(r.values()) for r in rows], f"symbol string, level string, time long, {kinds}")
    d = rules.with_rules(d).withColumn("tags", rules.entry_tags()).withColumn("enter", rules.enter_long())
    got = {r["symbol"]: r for r in d.groupBy("symbol").agg(F.max_by("tags", "time").alias("tags"), F.max_by("enter", "time").alias("enter")).collect()}
    assert list(FIRES) == rules.TAGS and all(f"{t} " in got[t]["tags"] and got[t]["enter"] == 1 for t in FIRES)
    assert got["none"]["tags"] == got["null"]["tags"] == "" and got["none"]["enter"] is None
    assert got["bb"]["tags"].startswith("bb ") and d.where("symbol = 'none' and tags != ''").count() == 0


def test_each_exit_reason_fires(spark):
    base = dict(
        profit=-0.01, max_profit=-0.01, rsi=50.0, cmf=0.0, cmf_1h=0.0, cti=0.0, cti_1h=0.0, rsi_1h=60.0, r_14=-50.0, r_480_1h=-50.0, momdiv_sell=False, momdiv_sell_1h=False, momdiv_coh=False, close=100.0, ema_200=100.0, ema_4=90.0, pm=90.0,
        pmax_thresh=100.0, sma_21=100.0, fisher=0.0, ha_high=100.0, ha_close=98.0, bb_mid=100.0, bb_width=0.1, volume_mean_12=100.0, volume_mean_24=100.0, before_ha_high=100.0, before2_ha_high=100.0, before_ha_close=98.0, before_rsi=50.0, buy_tag=None,
    )
    t0, t1, q = dict(profit=0.005), dict(profit=0.015), dict(profit=0.03, max_profit=0.03)
    fires = {
        "sell_profit_t_0_1": dict(**t0, max_profit=0.06, rsi=45.0), "sell_profit_t_0_2": dict(**t0, max_profit=0.035, rsi=31.0), "sell_profit_t_0_3": dict(**t0, max_profit=0.06, rsi=47.0),
        "sell_profit_t_1_1": dict(**t1, max_profit=0.03, rsi=38.0), "sell_profit_t_1_2": dict(**t1, max_profit=0.055, rsi=44.0, cmf=-0.1, cmf_1h=-0.1), "sell_profit_t_1_4": dict(**t1, max_profit=0.04, rsi=39.5, cmf=-0.05, cti_1h=0.9),
        "sell_profit_t_1_5": dict(**t1, max_profit=0.06, rsi=48.0, cmf_1h=-0.1), "sell_profit_t_1_7": dict(**t1, max_profit=0.08, rsi=42.5, cmf=-0.05), "sell_profit_t_1_9": dict(**t1, max_profit=0.045, rsi=39.5, cmf=-0.2, rsi_1h=40.0),
        "sell_profit_t_1_10": dict(**t1, max_profit=0.045, rsi=45.0, cmf=-0.05, r_480_1h=-10.0), "sell_profit_t_1_11": dict(**t1, max_profit=0.045, rsi=41.0), "sell_profit_t_1_12": dict(**t1, max_profit=0.03, rsi=43.0, cmf=-0.3),
        "sell_profit_t_cti_r_0_1": dict(**t0, cti=0.9, r_14=-10.0), "signal_profit_q_momdiv_1h": dict(**q, momdiv_sell_1h=True), "signal_profit_q_momdiv": dict(**q, momdiv_sell=True), "signal_profit_q_momdiv_coh": dict(**q, momdiv_coh=True),
        "sell_profit_u_bear_1_1": dict(**t1, close=90.0, rsi=33.0, cmf=-0.1), "sell_profit_u_bear_1_2": dict(**t1, close=90.0, rsi=43.0, cmf=-0.5), "signal_profit_q_1": dict(**q, rsi=85.0), "signal_profit_q_2": dict(**q, cti=0.96),
        "signal_profit_q_pmax_bull": dict(**q, close=120.0), "signal_profit_q_pmax_bear": dict(**q, close=105.0, pm=110.0), "sell_scalp": dict(profit=0.1, buy_tag="nfix_39 ", fisher=0.5, ema_4=100.0, bb_mid=90.0),
        "sell_stoploss_u_e_1": dict(profit=-0.055, close=98.0, cmf=-0.1, rsi=62.0, rsi_1h=50.0), "sell_stoploss_deadfish": dict(profit=-0.07, close=98.0, bb_width=0.04),
    }
    kinds = ", ".join(f"{c} {'boolean' if isinstance(v, bool) else 'string' if v is None else 'double'}" for c, v in base.items())
    rows = [(name, *{**base, **over}.values()) for name, over in fires.items()] + [("none", *base.values()), ("other tag", *{**base, **fires["sell_scalp"], "buy_tag": "nfix_39 bb "}.values())]
    got = {r["name"]: r["r"] for r in spark.createDataFrame(rows, f"name string, {kinds}").select("name", rules.exit_chain().alias("r")).collect()}
    assert got == {n: f"{n}( {'nfix_39 ' if n == 'sell_scalp' else 'empty'})" for n in fires} | {"none": None, "other tag": None}


def plain_trades(bars, chain):
    """Trades of bars (time, open, high, low, close, holds, enter, tag) one by one; chain has (name, at_least, above, below, fall, tag)."""
    out, trade, signal = [], None, None
    for time, op, high, low, close, holds, enter, tag in bars:
        if trade is None and signal is not None and op > 0:
            trade = {"time": time, "rate": op, "tag": signal[0], "top": high, "stop": op * (1 - 0.99)}
        signal, why = None, None
        if trade is not None:
            trade["top"] = max(trade["top"], high)
            profit, top = close / trade["rate"] - 1, trade["top"] / trade["rate"] - 1
            age = (time - trade["time"]) / 60_000
            if low <= trade["stop"]:
                why, rate = "trailing_stop", trade["stop"]
            else:
                rate = close
                for k, (name, at_least, above, below, fall, own) in enumerate(chain):
                    if holds >> k & 1 and profit >= at_least and profit > above and profit < below and (fall is None or top > profit + fall) and own in (None, trade["tag"]):
                        why = f"{name}( {trade['tag'] or 'empty'})"
                        break
                if why is None and profit >= (0.005 if age >= 292 else 0.038 if age >= 81 else 0.205):
                    why = "take_profit"
            if why is None:
                for least, far in ((0.2, 0.05), (0.1, 0.03), (0.06, 0.02), (0.03, 0.015)):
                    if profit > least:
                        trade["stop"] = max(trade["stop"], close * (1 - far))
                        break
            else:
                out.append((len(out) + 1, trade["time"], time, trade["rate"], rate, trade["tag"], why))
                trade = None
        if trade is None and enter:
            signal = (tag or None,)
    return out


def test_rule_trades_one_by_one(spark, monkeypatch):
    """Every reason occurs, in batches of any size."""
    from tickloom.operators import rule_trades as rt

    chain = rules.exit_rules()
    bounds = rt.Bounds.of(chain)
    rows, wanted, seen = [], {}, set()
    for series_no in range(6):
        rng, price, bars = random.Random(series_no), 100.0, []
        for k in range(4000):
            op, price = price * (1 + rng.uniform(-0.002, 0.002)), max(1.0, price * (1 + rng.gauss(0, 0.02 if series_no % 2 else 0.006)))
            if k % 997 == 5:
                op = 0.0
            holds = sum(1 << rng.randrange(len(chain)) for _ in range(2)) if rng.random() < 0.3 else 0
            bars.append((k * (60_000 if series_no < 4 else 3_600_000), op, max(op, price) * rng.choice([1.002, 1.002, 1.07]), min(op, price) * (0.999 if rng.random() < 0.999 else 0.001), price, holds, rng.random() < 0.1, rng.choice(["nfix_39 ", "", "bb ewo "])))
        name = f"S{series_no}"
        rows += [(name, "1h", t, o, h, lo, c, x, 1 if e else None, tag) for t, o, h, lo, c, x, e, tag in bars]
        wanted[name] = plain_trades(bars, [(r.name, r.at_least, r.above, r.below, r.fall, r.tag) for r in chain])
        seen |= {t[-1].split("(")[0] for t in wanted[name]}
    assert seen >= {r.name for r in chain} | {"trailing_stop", "take_profit"}
    d = spark.createDataFrame(rows, "symbol string, level string, time long, open double, high double, low double, close double, holds long, enter_long int, buy_tag string")
    for size in (10_000, 113):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = rt.closed_trades(d, bounds, 0.0015, 100.0).orderBy("symbol", "trade_id").collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for name, want in wanted.items():
            have = [tuple(r)[2:9] for r in got if r["symbol"] == name]
            assert len(have) == len(want) and all(a[:3] == b[:3] and a[5:] == b[5:] and a[3:5] == pytest.approx(b[3:5], rel=1e-12) for a, b in zip(have, want)), name


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_series_split_in_time_equal_the_single_pass(spark, monkeypatch, stretch):
    """Nested steps, warm-ups longer than a stretch, gaps, columns that begin with nulls or hold some later."""
    from tickloom.functions import scan

    monkeypatch.setattr(scan, "STRETCH", stretch)
    rng, rows = random.Random(4), []
    for name, n in (("A", 400), ("B", 37), ("C", 1), ("D", 90)):
        at = 1_700_000_000_000
        for k in range(n):
            at += 3_600_000 * rng.choice([1, 1, 1, 2, 90])
            rows.append((name, "1h", at, rng.uniform(1, 9), None if k < 20 or k % 31 == 0 or name == "D" else rng.uniform(1, 9)))
    d = spark.createDataFrame(rows, "symbol string, level string, time long, x double, y double").repartition(5)
    steps = [scan.Step("e9", "ema", "x", 9), scan.Step("e0", "ema", "x", 0), scan.Step("ee", "ema", "e9", 5), scan.Step("eee", "ema", "ee", 3), scan.Step("w", "wilder", "y", 14), scan.Step("we", "ema", "w", 4), scan.Step("l", "linear", "y", q=0.9), scan.Step("one", "wilder", "x", 1)]
    want, got = (scan.recurrences(d, KEYS, steps, split=split).orderBy("symbol", "time").collect() for split in (False, True))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert tuple(a)[:5] == tuple(b)[:5]
        for c in [s.out for s in steps]:
            assert (a[c] is None) == (b[c] is None) and (a[c] is None or a[c] == pytest.approx(b[c], rel=1e-9)), (c, a, b)


def test_both_passes_of_a_split_series_read_one_shuffle(spark):
    d = series(spark, walk(300))
    found = ema(d.repartition(2), "close", 9, "e", KEYS, split=True)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 1


@pytest.mark.parametrize("span", [1, 50, 10**6])
def test_last_seen_split_in_time(spark, span):
    rng = random.Random(span)
    left = [(s, rng.randrange(2000), k) for s in "ABC" for k in range(150)]
    right = [(s, t, -k) for s in "ABD" for k, t in enumerate(rng.sample(range(300, 1500), 40))]
    one = spark.createDataFrame(left, "symbol string, at long, n long").select("symbol", "at", F.struct("n").alias("row"))
    two = spark.createDataFrame(right, "symbol string, at long, v long").select("symbol", "at", F.struct("v").alias("held"))
    for split in (False, True):
        got = {r["row"]["n"] if r["symbol"] == "A" else (r["symbol"], r["row"]["n"]): r["seen"] and r["seen"]["v"] for r in joins.last_seen(one, two, span, split).collect()}
        assert len(got) == len(left)
        for s, t, k in left:
            seen = [(at, v) for x, at, v in right if x == s and at <= t]
            assert got[k if s == "A" else (s, k)] == (max(seen)[1] if seen else None)


@pytest.mark.parametrize("stretch", [1, 3, 20])
@pytest.mark.parametrize("zeros", [False, True])
def test_sweeps_of_series_cut_in_time(spark, monkeypatch, stretch, zeros):
    """Any stretches give the scores of the whole: ties, flat bars, gaps, prices of 0."""
    from tickloom.operators import split_sweep

    monkeypatch.setattr(split_sweep, "STRETCH", stretch)
    monkeypatch.setattr(split_sweep, "PAIRS", 7)
    n, d = 60, None
    for no, name in enumerate(("A-B", "C-D", "E-F", "G-H")):
        closes = walk(n, no + 3)
        closes[5:12] = closes[5:6] * len(closes[5:12])
        opens = [round(c * (1 + (k % 5 - 2) / 300), 2) for k, c in enumerate(closes)]
        if zeros:
            closes[20 + no] = closes[41] = 0.0
            opens[(57, 30, 44, 10)[no]] = 0.0
        times = [3_600_000 * (k + (k > 25) * 7 * no) for k in range(n)]
        one = series(spark, closes, opens, times, symbol=name)
        d = one if d is None else d.unionByName(one)
    for strategy in (bt.DoubleEma(1, 2, 9), bt.SingleEma(1, 7), bt.DoubleEma(pairs=[(3, 8), (2, 5)])):
        whole, parts = ({tuple(r[c] for c in ("symbol", *strategy.params)): r for r in bt.array_scores(d, strategy, "1h", 0.0015, 1000.0, split=split).collect()} for split in (False, True))
        assert whole.keys() == parts.keys()
        for k, r in whole.items():
            assert all(same(r[c], parts[k][c]) for c in ("final_value", "max_dd", "sharpe", "bars")), (k, r, parts[k])


def test_frames_in_batches_of_any_size(spark):
    """Steps over the last n values against plain frames, nulls and short series included."""
    from tickloom.functions import scan

    rng = random.Random(8)
    x = [None if k in (40, 41, 70) else rng.uniform(-5, 5) for k in range(150)]
    rows = [("A", "1h", k, v) for k, v in enumerate(x)] + [("B", "1h", k, 1.0 * k) for k in range(3)]
    d = spark.createDataFrame(rows, "symbol string, level string, time long, x double")
    lengths = (1, 2, 7, 30)
    steps = [scan.Step(f"{kind}_{n}", kind, "x", n) for n in lengths for kind in ("max", "min", "mean", "deviation", "weighted")]
    for size in (10_000, 11):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = scan.recurrences(d, KEYS, steps).orderBy("symbol", "time").collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        for r in got:
            own = x if r["symbol"] == "A" else [0.0, 1.0, 2.0]
            for n in lengths:
                f = own[max(0, r["time"] - n + 1) : r["time"] + 1]
                want = [None] * 5
                if len(f) == n and None not in f:
                    mean = sum(f) / n
                    want = [max(f), min(f), mean, sum(abs(v - mean) for v in f) / n, sum(w * v for w, v in enumerate(f, 1)) / (n * (n + 1) / 2)]
                have = [r[f"{kind}_{n}"] for kind in ("max", "min", "mean", "deviation", "weighted")]
                assert have == (want if want[0] is None else pytest.approx(want, rel=1e-9, abs=1e-12)), (n, r)


def test_a_batch_rewrites_only_its_months(spark, tmp_path, monkeypatch):
    """Other months keep their files; a batch that breaks off between two steps is repeated and loses nothing."""
    landing, table = f"{tmp_path}/landing", tmp_path / "table"
    day = 86_400_000
    bars = spark.createDataFrame([(s, "1m", k * day, 1.0, 1.0, 1.0, float(k), None) for s in ("A-B", "C-D") for k in range(70)], src.SCHEMA)
    src.write_candles(bars, str(table))
    files = {f: f.stat().st_mtime_ns for f in table.rglob("*.parquet")}
    assert {f.parent.name for f in files} == {"period=1970-01", "period=1970-02", "period=1970-03"}
    payload = f'[["{40 * day + 60_000}","7","7","7","7"],["{40 * day}","9","9","9","9"]]'
    spark.createDataFrame([("A-B", "1m", payload)], ingest.LANDED).write.parquet(landing)
    real, calls = ingest.write_candles, []

    def breaks(df, path):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("lost")
        real(df, path)

    monkeypatch.setattr(ingest, "write_candles", breaks)
    with pytest.raises(Exception):
        ingest.ingest_stream(spark, landing, str(table), f"{tmp_path}/checkpoint").awaitTermination()
    assert {f: f.stat().st_mtime_ns for f in table.rglob("*.parquet")} == files
    ingest.ingest_stream(spark, landing, str(table), f"{tmp_path}/checkpoint").awaitTermination()
    now = {f: f.stat().st_mtime_ns for f in table.rglob("*.parquet")}
    changed = {f for f in files if now.get(f) != files[f]}
    assert {(f.parent.parent.parent.name, f.parent.name) for f in changed} == {("symbol=A-B", "period=1970-02")}
    got = src.read_candles(spark, str(table))
    assert got.count() == 141 and column(got.where(f"symbol = 'A-B' and time between {40 * day} and {40 * day + 60_000}"), "close") == [40.0, 7.0]


def test_results_have_one_header(spark, tmp_path):
    rows = [("a,b", 'say "x"'), ("fast=5,slow=10", "2")]
    for row in rows:
        src.append_result(spark.createDataFrame([row], "Filename string, Params string"), f"{tmp_path}/r")
    (file,) = (tmp_path / "r").glob("*.csv")
    assert file.read_text().splitlines() == ["Filename,Params", '"a,b","say ""x"""', '"fast=5,slow=10",2']
    (tmp_path / "r").rename(tmp_path / "r-before")  # as if broken off
    src.append_result(spark.createDataFrame([("c", "3")], "Filename string, Params string"), f"{tmp_path}/r")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["r"] and len(next((tmp_path / "r").glob("*.csv")).read_text().splitlines()) == 4


def test_streams_of_all_levels_equal_the_batch(spark, tmp_path):
    """Months and weeks included, in several batches, rows late within the watermark's delay, ties of times, missing volumes; too late ones are left out."""
    rng = random.Random(3)
    start, rows = 1_706_000_000_000, []
    for k in range(600):
        start += rng.choice([1000, 50_000, 3_000_000, 30_000_000])
        rows.append((rng.choice("ab"), start - rng.choice([0, 0, 0, 600_000]), k, rng.uniform(1, 9), None if k % 7 == 0 else 1.0))
    rows += [("a", rows[-1][1], 9000, 5.0, 1.0), ("a", rows[-1][1], 9001, 6.0, 1.0)]
    late = [("b", rows[10][1], 9999, 1000.0, 1.0)]
    last = [("z", start + 90 * 86_400_000, 10_000, 1.0, 1.0)]
    kind = "symbol string, ms long, seq long, price double, volume double"
    frame = lambda r: spark.createDataFrame(r, kind).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1)
    for k, part in enumerate((rows[:200], rows[200:400], rows[400:], late, last, [(*last[0][:1], last[0][1] + 1, *last[0][2:])])):
        frame(part).write.mode("append").parquet(f"{tmp_path}/ticks")
        found = ingest.candle_streams(spark.readStream.schema(frame(rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/ticks"))
        q = found.writeStream.format("parquet").option("path", f"{tmp_path}/bars").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["symbol"], r["level"], r["time"]): tuple(r)[3:] for r in spark.read.parquet(f"{tmp_path}/bars").collect()}
    want = {}
    for level, _, _ in build.LEVELS:
        want |= {(r["symbol"], level, r["time"]): tuple(r)[3:] for r in build.build_candles(frame(rows), level).collect()}
    assert {k: v for k, v in got.items() if k[0] != "z"}.keys() == want.keys() and len({k[1] for k in want}) == 14
    for k, v in want.items():
        assert got[k][:4] == v[:4] and (got[k][4] == v[4] or got[k][4] == pytest.approx(v[4])), (k, got[k], v)


@pytest.mark.parametrize("stretch", [1, 3, 20])
@pytest.mark.parametrize("zeros", [False, True])
def test_rows_of_runs_cut_in_time(spark, monkeypatch, stretch, zeros):
    """Each bar's position, value, peak and return are those of the row layout, however series are cut."""
    from tickloom.operators import split_sweep

    monkeypatch.setattr(split_sweep, "STRETCH", stretch)
    n, d = 60, None
    for no, name in enumerate(("A-B", "C-D")):
        closes = walk(n, no + 3)
        closes[5:12] = closes[5:6] * len(closes[5:12])
        opens = [round(c * (1 + (k % 5 - 2) / 300), 2) for k, c in enumerate(closes)]
        if zeros:
            closes[20 + no] = closes[41] = 0.0
        times = [3_600_000 * (k + (k > 25) * 7 * no) for k in range(n)]
        one = series(spark, closes, opens, times, symbol=name)
        d = one if d is None else d.unionByName(one)
    for strategy in (bt.DoubleEma(pairs=[(3, 8), (2, 5), (4, 9)]), bt.SingleEma(2, 4)):
        keys = ("symbol", *strategy.params, "time")
        whole, parts = ({tuple(r[c] for c in keys): r for r in x.collect()} for x in (bt.runs(d, strategy, 0.0015, 1000.0), split_sweep.split_runs(d, strategy, "1h", 0.0015, 1000.0)))
        assert whole.keys() == parts.keys()
        for k, r in whole.items():
            assert r["held"] == parts[k]["held"] and all((r[c] is None) == (parts[k][c] is None) and (r[c] is None or same(r[c], parts[k][c])) for c in ("value", "peak", "ret")), (k, r, parts[k])
