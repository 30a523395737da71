"""Registered queries against their SQL, on the smallest tables; and the whole entry module."""

import duckdb
import pytest

import __spark_entry__
from tickloom.plans import registry

TINY = "/root/testdata/sf0.001"
CHECKED = ["candles_hourly", "rollup_4h", "normalize_report", "interval_check", "freshness_plan", "parse_klines", "ema_grid", "bollinger", "rsi", "pmax", "asof_merge", "backtest", "trades", "daily_equity", "daily_sharpe", "loss_score", "sweep_top3", "sweep_15m", "cci_family", "rmi_family", "keltner_gap", "open_close_range", "trailing_stop"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    return con


def cell(x):
    return None if x is None else round(float(x), 4) if isinstance(x, float) else x


def test_every_query_has_a_callable_and_sql_names_a_query():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and all(map(callable, names.values())) and set(registry.QUERIES) <= set(names)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, TINY)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(cell(x) for x in r) for r in found.fetchall()), key=repr)
    have = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert len(have) == len(want) and all(a == b or all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-4 for x, y in zip(a, b)) for a, b in zip(have, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
