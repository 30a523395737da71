"""What the findings of round 3 named."""

import numpy as np
import pyarrow as pa
import pytest

from tests.test_core import column, same, series, walk
from tickloom.functions import indicators as ind
from tickloom.llm import checks, lm_score
from tickloom.llm import decontaminate as dc
from tickloom.llm import language
from tickloom.llm.common import Lookup, utf8
from tickloom.operators import backtest as bt
from tickloom.operators import split_sweep
from tickloom.plans import registry


def test_changes_from_a_price_of_zero(spark):
    d = spark.createDataFrame([("A-B", "1h", k, 5.0, high, low, close, 1.0) for k, (high, low, close) in enumerate([(9.0, 3.0, 4.0), (8.0, 0.0, 0.0), (6.0, 2.0, 3.0), (5.0, 2.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)])], "symbol string, level string, time long, open double, high double, low double, close double, volume double")
    inf, nan = float("inf"), float("nan")
    assert list(map(repr, column(ind.range_change(d, "HL", 2), "hl_change_2"))) == list(map(repr, [None, inf, inf, 2.0, inf, nan]))
    assert column(ind.range_change(d, "OC", 2), "oc_change_2") == [None, None, None, None, None, None]
    assert list(map(repr, column(ind.roc(d, 1), "rocr_1"))) == list(map(repr, [None, 0.0, inf, 0.0, nan, nan]))


def plain_ratio(opens, closes, follow, fee=0.0015, per_year=8760):
    """Sharpe ratio of each bar's factor less one; none counts after a close of 0 that is held, and a purchase at 0 gives 0."""
    held, returns = False, []
    for k in range(1, len(closes)):
        was, held = held, bool(follow[k - 1])
        if held and not was:
            if opens[k] == 0:
                return 0.0
            returns.append((1 - fee) * closes[k] / opens[k] - 1)
        elif was:
            if closes[k - 1]:
                returns.append((closes[k] if held else (1 - fee) * opens[k]) / closes[k - 1] - 1)
        else:
            returns.append(0.0)
    sd = np.std(returns, ddof=1)
    return float(np.mean(returns) / sd * per_year**0.5) if sd > 1e-15 else 0.0


@pytest.mark.parametrize("zero_closes, zero_opens", [((), (40,)), ((30,), (31, 40, 41, 60)), ((), ()), ((12, 55), (56, 20, 33)), ((), tuple(range(20, 120, 3)))])
def test_returns_after_a_sale_at_zero_count_in_all_layouts(spark, zero_closes, zero_opens):
    closes = walk(130, 3)
    opens = [round(c * (1 + (k % 5 - 2) / 300), 2) for k, c in enumerate(closes)]
    for prices, places in ((closes, zero_closes), (opens, zero_opens)):
        for k in places:
            prices[k] = 0.0
    d = series(spark, closes, opens, [3_600_000 * k for k in range(130)])
    strategy = bt.DoubleEma(1, 2, 9)
    stretch, split_sweep.STRETCH = split_sweep.STRETCH, 23
    try:
        parts = [bt.array_scores(d, strategy, "1h", 0.0015, 1000.0, split, after_loss=True).collect() for split in (False, True)]
    finally:
        split_sweep.STRETCH = stretch
    parts.append(bt.relational_scores(d, strategy, "1h", 0.0015, 1000.0, after_loss=True).collect())
    before = {(r["fast"], r["slow"]): r for r in bt.backtest(d, strategy, "1h").collect()}
    lost = 0
    for pair, follow in strategy.follow(np.array(closes), [p for t in strategy.tiles() for p in t]):
        want = plain_ratio(opens, closes, follow)
        for k, rows in enumerate(parts):
            found = next(r for r in rows if (r["fast"], r["slow"]) == pair)
            assert same(found["sharpe"], want), (k, pair, found, want)
            assert k == 2 or same(found["final_value"], before[pair]["final_value"]) and same(found["max_dd"], before[pair]["max_dd"]), (k, pair, found, before[pair])
        lost += before[pair]["final_value"] == 0 and not same(before[pair]["sharpe"], want)
    assert lost or not zero_opens


def test_the_logarithm_of_nothing(spark):
    got = registry.in_logs(spark.createDataFrame([(0.0,), (1.0,), (float("inf"),)], "final_value double"))
    assert [r[0] for r in got.collect()] == [float("-inf"), 0.0, float("inf")]


def test_latent_spaces_come_from_all_halves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary, int(n))) for n in rng.integers(1, 200, 80)] + [None, "", "w1 " * 500]
    words = [np.array(vocabulary[:25]), np.array(vocabulary[10:50])]
    hashed = lambda x: np.unique(dc.words_of(*utf8(pa.array(list(x), pa.large_string()))).hashes())
    keys = [hashed(x) for x in words]
    every = np.unique(np.concatenate(keys))
    monkeypatch.setattr(dc, "MOST_PAIRS", 40)  # sums are given out and added up again
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    rows = dc.pair_rows(docs, every, [Lookup(k).find(every) for k in keys], list(map(len, keys))).collect()
    want = [np.zeros((len(k), len(k)), np.int64) for k in keys]
    for text in texts:
        h = dc.words_of(*utf8(pa.array([text or ""]))).hashes()
        for a in range(0, len(h), dc.HALF):
            for k, own in enumerate(keys):
                n = (h[a : a + dc.HALF][:, None] == own).sum(0)
                want[k] += np.outer(n, n)
    got = [np.zeros_like(w) for w in want]
    for r in rows:
        got[r["part"]][r["r"], r["at"]] = r["n"]
    assert all((a == b).all() for a, b in zip(got, want))
    # the vectors are those of the whole matrix
    weight = rng.random(len(keys[0])) + 0.5
    own = rng.random((4, len(keys[0])))
    vectors = dc.randomised_svd(spark.createDataFrame([r for r in rows if r["part"] == 0]).drop("part").selectExpr("cast(r as int) r", "cast(at as array<int>) at", "n"), 0.25, own, weight, 8)
    whole = own.T @ own + 0.25 * weight[:, None] * want[0] * weight
    assert np.trace(vectors.T @ whole @ vectors) == pytest.approx(np.sort(np.linalg.eigvalsh(whole))[-8:].sum(), rel=1e-4)


def test_a_long_text_has_its_halves_once(spark, monkeypatch):
    text = " ".join(f"w{k % 90}" for k in range(5000))
    keys = np.unique(dc.words_of(*utf8(pa.array([text]))).hashes())
    batch = pa.RecordBatch.from_arrays([pa.array(["a b", text, "w1"])], names=["text"])
    whole = next(dc.count_halves(keys)(iter([batch]))).to_pydict()
    pairs = pa.Table.from_batches(dc.feature_pairs(keys, [np.arange(len(keys))], [len(keys)])(iter([batch]))).to_pydict()
    monkeypatch.setattr(dc.parts_of, "__defaults__", (700,))
    assert next(dc.count_halves(keys)(iter([batch]))).to_pydict() == whole
    assert pa.Table.from_batches(dc.feature_pairs(keys, [np.arange(len(keys))], [len(keys)])(iter([batch]))).to_pydict() == pairs


def test_all_texts_of_the_fold_calibrate_the_language_score(spark):
    words = {"en": ["the", "of", "and", "house"], "de": ["der", "und", "das", "haus"]}
    rng = np.random.default_rng(2)
    rows = [(" ".join(rng.choice(words[x if rng.random() < 0.8 else "de"], 3)) + f" {k}", x) for k in range(6000) for x in words]
    d = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(d)
    seen = language.Model(model.langs, model.matrix, model.prior)
    held = d.where(f"pmod(xxhash64(text), {language.FOLDS}) = 0").collect()
    loss = np.zeros(len(language.GRAINS))
    for r in held:
        logs, n = language.logs_of(seen, *utf8(pa.array([r["text"]])))
        loss += [-np.log(max(1e-9, language.shares(logs, n, g)[0, model.langs.index(r["lang"])])) for g in language.GRAINS]
    sums = d.where(f"pmod(xxhash64(text), {language.FOLDS}) = 0").repartition(3).mapInArrow(language.losses(spark.sparkContext.broadcast(seen)), "grain double, loss long, n long").groupBy("grain").agg({"loss": "sum", "n": "sum"}).orderBy("grain").collect()
    assert [r["sum(n)"] for r in sums] == [len(held)] * len(loss) and [r["sum(loss)"] * language.LOSS_UNIT for r in sums] == pytest.approx(list(loss), rel=1e-4)
    assert loss[list(language.GRAINS).index(model.grain)] == pytest.approx(loss.min(), rel=1e-4)


def test_the_base_needs_no_trained_model(spark, monkeypatch):
    whole = {r["doc_id"]: r for r in lm_score.op2(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(lm_score, "train_part", None)
    got = checks.lm_base(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(whole) and all(r[c] == whole[r["doc_id"]][c] for r in got for c in ("held_out", "n_tokens", "n_known", "train_tokens"))
    assert all(r["base_score"] == round(whole[r["doc_id"]]["base_score"], 4) for r in got)
