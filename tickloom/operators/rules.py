"""Entry rules over indicators, their tags, and the reasons to leave a trade.

``features`` gives a series all columns that the rules read, in two passes along it; columns of a
coarser interval carry the suffix ``_1h``. A comparison with null is false, as is a rule that reads
one. Every rule is a Column, so all are evaluated in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.functions.indicators import KEYS, lag, rolling
from tickloom.functions.scan import Step, recurrences
from tickloom.operators.joins import alive_bars, asof_merge

# The thresholds of the entry rules.
ENTRY = {
    "bb_width_1h": 0.954, "roc_1h": 86, "bb_factor": 0.999, "bb_delta": 0.025, "bb_width": 0.095,
    "cci": -116, "cci_length": 25, "rmi": 49, "rmi_length": 17, "srsi_fk": 32, "closedelta": 17.922, "ema_diff": 0.026,
    "ema_high": 0.968, "ema_low": 0.935, "ewo": -5.001, "rsi": 23, "rsi_fast": 44,
    "ema_high_2": 1.087, "ema_low_2": 0.970, "ewo_high_2": 4.179, "rsi_ewo_2": 35, "rsi_fast_ewo_2": 45,
    "closedelta_local_dip": 12.044, "ema_diff_local_dip": 0.024, "ema_high_local_dip": 1.014, "rsi_local_dip": 21, "crsi_local_dip": 10,
    "r_deadfish_bb_factor": 1.014, "r_deadfish_bb_width": 0.299, "r_deadfish_ema": 1.054, "r_deadfish_volume_factor": 1.59, "r_deadfish_cti": -0.115, "r_deadfish_r14": -44.34,
    "clucha_bbdelta_close": 0.049, "clucha_bbdelta_tail": 1.146, "clucha_closedelta_close": 0.017, "clucha_rocr_1h": 0.526,
    "adx": 13, "cofi_r14": -85.016, "cofi_cti": -0.892, "ema_cofi": 1.147, "ewo_high": 8.594, "fastd": 28, "fastk": 39,
    "gumbo_ema": 1.121, "gumbo_ewo_low": -9.442, "gumbo_cti": -0.374, "gumbo_r14": -51.971,
    "sqzmom_ema": 0.981, "sqzmom_ewo": -3.966, "sqzmom_r14": -45.068, "nfix_39_ema": 0.912, "nfix_49_cti": -0.105, "nfix_49_r14": -81.827,
}
# The thresholds of the exit chain.
EXIT = {"cti_r_cti": 0.844, "cti_r_r": -19.99, "deadfish_profit": -0.063, "deadfish_bb_factor": 0.954, "deadfish_bb_width": 0.043, "deadfish_volume_factor": 2.37}
# Fixed values: (reason, least profit, profit below, fall from the highest profit, RSI below, further columns below or above a bound).
TRAILS = (
    ("t_0_1", 0.0, 0.012, 0.045, 46.0, {}), ("t_0_2", 0.0, 0.012, 0.025, 32.0, {}), ("t_0_3", 0.0, 0.012, 0.05, 48.0, {}),
    ("t_1_1", 0.012, 0.02, 0.01, 39.0, {}), ("t_1_2", 0.012, 0.02, 0.035, 45.0, {"cmf": ("<", 0.0), "cmf_1h": ("<", 0.0)}),
    ("t_1_4", 0.012, 0.02, 0.02, 40.0, {"cmf": ("<", 0.0), "cti_1h": (">", 0.8)}), ("t_1_5", 0.012, 0.02, 0.04, 49.0, {"cmf_1h": ("<", 0.0)}),
    ("t_1_7", 0.012, 0.02, 0.06, 43.0, {"cmf": ("<", 0.0)}), ("t_1_9", 0.012, 0.02, 0.025, 40.0, {"cmf": ("<", -0.1), "rsi_1h": ("<", 50.0)}),
    ("t_1_10", 0.012, 0.02, 0.025, 46.0, {"cmf": ("<", 0.0), "r_480_1h": (">", -20.0)}), ("t_1_11", 0.012, 0.02, 0.025, 42.0, {}),
    ("t_1_12", 0.012, 0.02, 0.01, 44.0, {"cmf": ("<", -0.25)}),
)

#: Columns of the coarser interval that the rules read.
COARSE = ["ema_50", "ema_100", "ema_200", "cti", "crsi", "r_480", "bb_mid", "bb_width", "roc", "momdiv_sell", "rsi", "cmf", "rocr_168", "t3", "safe_dump"]
RSI = {14: "rsi", 4: "rsi_fast", 20: "rsi_slow", 15: "_rsi_15", 3: "_rsi_3"}


def features(candles: DataFrame) -> DataFrame:
    """Candles with the indicators that the rules read."""
    own = lambda x, n: rolling(F.avg, x, n)
    d = candles.withColumns({
        "ha_close": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4,
        "_c": F.col("close") - lag("close"), "_c4": F.col("close") - lag("close", 4), "_up": F.col("high") - lag("high"), "_dn": lag("low") - F.col("low"),
        "_roc": (F.try_divide(F.col("close"), lag("close", 100)) - 1) * 100, "roc": (F.try_divide(F.col("close"), lag("close", 9)) - 1) * 100,
        "_vw": F.try_divide(own(F.col("close") * F.col("volume"), 96), own("volume", 96)),
    })
    d = ind.money_flow(ind.volume_means(ind.sma(d, (15, 21, 28, 30, 75))))
    d = ind.band_shapes(d).withColumn("_x", ind.typical_price())
    d = ind.fast_stochastic(ind.squeeze_momentum(ind.correlation_trend(ind.keltner(d, 28, 1), 20)))
    d = d.withColumns({
        "closedelta": F.abs("_c"), "_tr": ind.true_range(), "_s": F.coalesce(F.signum("_c"), F.lit(0.0)), "_ha": F.coalesce(lag("ha_close") / 2, (F.col("open") + F.col("close")) / 2),
        "rocr_168": F.try_divide(F.col("ha_close"), lag("ha_close", 168)), "ha_closedelta": F.abs(F.col("ha_close") - lag("ha_close")),
        "_pdm": F.when(F.col("_up").isNull(), None).when((F.col("_up") > F.col("_dn")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
        "_mdm": F.when(F.col("_up").isNull(), None).when((F.col("_dn") > F.col("_up")) & (F.col("_dn") > 0), F.col("_dn")).otherwise(0.0),
    })
    d = d.withColumns(ind.ups_and_downs(F.col("_c"), "_a")).withColumns(ind.ups_and_downs(F.col("_c4"), "_m")).withColumns(ind.ups_and_downs(F.col("_s") - lag("_s"), "_s"))
    steps = [Step(f"ema_{n}", "ema", "close", n) for n in (4, 8, 12, 13, 16, 20, 26, 50, 100, 200)]
    steps += [Step("pmax_thresh", "ema", "ha_close", 9), Step("_vwe", "ema", "_vw", 96), *ind.t3_steps(5), Step("ha_open", "linear", "_ha", q=0.5)]
    steps += [s for n, name in RSI.items() for s in ind.strength_steps("_a", n, name)] + ind.strength_steps("_s", 2, "_rsi_s") + ind.strength_steps("_m", ENTRY["rmi_length"], "rmi")
    steps += [*ind.williams_steps(14), *ind.williams_steps(480), *ind.cci_steps(ENTRY["cci_length"]), Step("_top", "max", "high", 30), Step("_bottom", "min", "low", 30)]
    d = recurrences(d, KEYS, steps + [Step(f"{c}w", "wilder", c, 14) for c in ("_tr", "_pdm", "_mdm")])
    d = ind.momentum_of(d.withColumns({"r_14": ind.williams_of(14), "r_480": ind.williams_of(480), "cci": ind.cci_of(ENTRY["cci_length"])}))
    d = ind.dump_guard(d)
    d = d.withColumns({name: ind.strength_of(name) for name in (*RSI.values(), "_rsi_s", "rmi")})
    d = d.withColumns({
        "crsi": (F.col("_rsi_3") + F.col("_rsi_s") + F.col("_roc")) / 3, "fisher": F.tanh(0.1 * (F.col("rsi") - 50)), "ewo": F.try_divide(F.col("ema_50") - F.col("ema_200"), F.col("low")) * 100,
        "moderi": F.coalesce(F.col("_vwe") >= lag("_vwe"), F.lit(False)), "t3": ind.t3_of(), "_dx": ind.direction(),
        "ha_high": F.greatest("high", "ha_open", "ha_close"), "ha_low": F.least("low", "ha_open", "ha_close"),
    })
    low, high = rolling(F.min, "_rsi_15", 20), rolling(F.max, "_rsi_15", 20)
    before = lag("ha_close")
    d = ind.ha_bands(d).withColumns({
        "srsi_k": F.try_divide(F.col("_rsi_15") - low, high - low) * 100, "tail": F.abs(F.col("ha_close") - F.col("ha_low")), "_hx": (F.col("ha_open") + F.col("ha_high") + F.col("ha_low") + F.col("ha_close")) / 4,
        "_htr": F.when(before.isNotNull(), F.greatest(F.col("ha_high") - F.col("ha_low"), F.abs(F.col("ha_high") - before), F.abs(F.col("ha_low") - before))),
    })
    d = recurrences(d, KEYS, [Step("adx", "wilder", "_dx", 14), Step("_hm", "ema", "_hx", 9), Step("_ha_atr", "wilder", "_htr", 10), Step("pm", "trail", "_hm", 10, 2.7, "_ha_atr")])
    d = d.withColumnsRenamed({"bb2_low": "bb_low", "bb2_mid": "bb_mid", "bb2_up": "bb_up", "bb3_low": "bb3_low_", "cti_20": "cti"}).withColumnsRenamed({"bb3_low_": "bb3_low"})
    return d.select(*[c for c in d.columns if not c.startswith("_")])


def with_coarse(base: DataFrame, coarse: DataFrame, base_ms: int, coarse_ms: int) -> DataFrame:
    """Features of the base interval with those of COARSE, as far as its bars have closed, suffix ``_1h``."""
    if coarse is base and base_ms == coarse_ms:  # every bar has just closed itself
        return base.withColumns({f"{c}_1h": F.col(c) for c in COARSE})
    return asof_merge(base, coarse, COARSE, "_1h", base_ms, coarse_ms)


def entry_rules(p: dict[str, float] = ENTRY) -> dict[str, Column]:
    """The rules by tag, in the order of the tags."""
    c = F.col
    rising = (c("ema_200_1h") > lag("ema_200_1h", 12)) & (lag("ema_200_1h", 12) > lag("ema_200_1h", 24))
    gap, gap_before = c("ema_26") - c("ema_12"), lag("ema_26") - lag("ema_12")
    dip = (c("rmi") < p["rmi"]) & (c("cci") <= p["cci"]) & (c("srsi_k") < p["srsi_fk"])
    breaks = (c("bb_delta") > p["bb_delta"]) & (c("bb_width") > p["bb_width"]) & (c("closedelta") > c("close") * p["closedelta"] / 1000) & (c("close") < c("bb3_low") * p["bb_factor"])
    squeeze_off = (c("bb_low") < c("kc_low_28")) & (c("bb_up") > c("kc_up_28"))
    line = c("linreg_20")
    bear, calm = c("pm") > c("pmax_thresh"), c("close") < c("sma_75") * 0.98
    low_band = lag("bbh_low")
    rules = {
        "bb": dip & breaks,
        "local_uptrend": (gap > 0) & (gap > c("open") * p["ema_diff"]) & (gap_before > c("open") / 100) & (c("close") < c("bb_low") * p["bb_factor"]) & (c("closedelta") > c("close") * p["closedelta"] / 1000),
        "local_dip": (gap > 0) & (gap > c("open") * p["ema_diff_local_dip"]) & (gap_before > c("open") / 100) & (c("close") < c("ema_20") * p["ema_high_local_dip"]) & (c("rsi") < p["rsi_local_dip"])
        & (c("crsi") > p["crsi_local_dip"]) & (c("closedelta") > c("close") * p["closedelta_local_dip"] / 1000),
        "ewo": (c("rsi_fast") < p["rsi_fast"]) & (c("close") < c("ema_8") * p["ema_low"]) & (c("ewo") > p["ewo"]) & (c("close") < c("ema_16") * p["ema_high"]) & (c("rsi") < p["rsi"]),
        "ewo2": rising & (c("rsi_fast") < p["rsi_fast_ewo_2"]) & (c("close") < c("ema_8") * p["ema_low_2"]) & (c("ewo") > p["ewo_high_2"]) & (c("close") < c("ema_16") * p["ema_high_2"]) & (c("rsi") < p["rsi_ewo_2"]),
        "r_deadfish": (c("ema_100") < c("ema_200") * p["r_deadfish_ema"]) & (c("bb_width") > p["r_deadfish_bb_width"]) & (c("close") < c("bb_mid") * p["r_deadfish_bb_factor"])
        & (c("volume_mean_12") > c("volume_mean_24") * p["r_deadfish_volume_factor"]) & (c("cti") < p["r_deadfish_cti"]) & (c("r_14") < p["r_deadfish_r14"]),
        "clucHA": (c("rocr_168_1h") > p["clucha_rocr_1h"]) & (low_band > 0) & (c("bb_delta_cluc") > c("ha_close") * p["clucha_bbdelta_close"]) & (c("ha_closedelta") > c("ha_close") * p["clucha_closedelta_close"])
        & (c("tail") < c("bb_delta_cluc") * p["clucha_bbdelta_tail"]) & (c("ha_close") < low_band) & (c("ha_close") < lag("ha_close")),
        "cofi": (c("open") < c("ema_8") * p["ema_cofi"]) & ind.crossed_above(c("fastk"), c("fastd")) & (c("fastk") < p["fastk"]) & (c("fastd") < p["fastd"]) & (c("adx") > p["adx"])
        & (c("ewo") > p["ewo_high"]) & (c("cti") < p["cofi_cti"]) & (c("r_14") < p["cofi_r14"]),
        "gumbo": (c("ewo") < p["gumbo_ewo_low"]) & (c("bb_mid_1h") >= c("t3_1h")) & (c("t3") <= c("ema_8") * p["gumbo_ema"]) & (c("cti") < p["gumbo_cti"]) & (c("r_14") < p["gumbo_r14"]),
        "sqzmom": squeeze_off & (lag(line, 2) > lag(line)) & (lag(line) < line) & (line < 0) & (c("close") < c("ema_13") * p["sqzmom_ema"]) & (c("ewo") < p["sqzmom_ewo"]) & (c("r_14") < p["sqzmom_r14"]),
        "nfi_13": (c("ema_50_1h") > c("ema_100_1h")) & (c("close") < c("sma_30") * 0.99) & (c("cti") < -0.92) & (c("ewo") < -5.585) & (c("cti_1h") < -0.88) & (c("crsi_1h") > 10.0),
        "nfi_32": (c("rsi_slow") < lag("rsi_slow")) & (c("rsi_fast") < 46) & (c("rsi") > 25.0) & (c("close") < c("sma_15") * 0.93) & (c("cti") < -0.9),
        "nfi_33": (c("close") < c("ema_13") * 0.978) & (c("ewo") > 8) & (c("cti") < -0.88) & (c("rsi") < 32) & (c("r_14") < -98.0) & (c("volume") < c("volume_mean_4") * 2.5),
        "nfi_38": bear & calm & (c("ewo") < -4.4) & (c("cti") < -0.95) & (c("r_14") < -97) & (c("crsi_1h") > 0.5),
        "nfix_5": rising & (c("close") < c("sma_75") * 0.932) & (c("ewo") > 3.6) & (c("cti") < -0.9) & (c("r_14") < -97.0),
        "nfix_39": rising & (low_band > 0) & (c("bb_delta_cluc") > c("close") * 0.056) & (c("closedelta") > c("close") * 0.01) & (c("tail") < c("bb_delta_cluc") * 0.5)
        & (c("close") < low_band) & (c("close") <= lag("close")) & (c("close") > c("ema_13") * p["nfix_39_ema"]),
        "nfix_49": (lag(gap, 3) > 0) & (lag(gap, 3) > lag("open", 3) * 0.032) & (lag(gap, 9) > lag("open", 3) / 100) & (lag("close", 3) < lag("ema_20", 3) * 0.916) & (lag("rsi", 3) < 32.5) & (lag("crsi", 3) > 18.0)
        & (c("cti") < p["nfix_49_cti"]) & (c("r_14") < p["nfix_49_r14"]),
        "nfi7_33": c("moderi") & (c("cti") < -0.88) & (c("close") < c("ema_13") * 0.988) & (c("ewo") > 6.4) & (c("rsi") < 32.0) & (c("volume") < c("volume_mean_4") * 2.0),
        "nfi7_37": bear & calm & (c("ewo") > 9.8) & (c("rsi") < 56.0) & (c("cti") < -0.7) & c("safe_dump_1h"),
    }
    return {tag: F.coalesce(rule, F.lit(False)) for tag, rule in rules.items()}


def with_rules(df: DataFrame, p: dict[str, float] = ENTRY) -> DataFrame:
    """df (features with coarse ones) with a column rule_<tag> for each rule."""
    return df.withColumns({f"rule_{tag}": rule for tag, rule in entry_rules(p).items()})


TAGS = ["bb", "local_uptrend", "local_dip", "ewo", "ewo2", "r_deadfish", "clucHA", "cofi", "gumbo", "sqzmom", "nfi_13", "nfi_32", "nfi_33", "nfi_38", "nfix_5", "nfix_39", "nfix_49", "nfi7_33", "nfi7_37"]


def entry_tags() -> Column:
    """The tags of the rules that hold, each with a space after it."""
    return F.concat(*[F.when(F.col(f"rule_{t}"), f"{t} ").otherwise("") for t in TAGS])


def enter_long(p: dict[str, float] = ENTRY) -> Column:
    """1 where any rule holds and the coarser interval neither rose nor spread too much; else null."""
    check = (F.col("roc_1h") < p["roc_1h"]) & (F.col("bb_width_1h") < p["bb_width_1h"])
    return F.when(check & reduce(lambda a, b: a | b, (F.col(f"rule_{t}") for t in TAGS)), 1)


NO_END = float("inf")


@dataclass(frozen=True)
class ExitRule:
    """A reason to leave a trade: bounds of its profit, how far its highest profit must be above, its tags (None: any), and what the bar's features must be."""

    name: str
    holds: Column
    at_least: float = -NO_END
    above: float = -NO_END
    below: float = NO_END
    fall: float | None = None
    tag: str | None = None

    def of(self, profit: Column, top: Column) -> Column:
        found = self.holds
        for bound, test in ((self.at_least, profit >= self.at_least), (self.above, profit > self.above), (self.below, profit < self.below)):
            found = found & test if abs(bound) < NO_END else found
        found = found if self.fall is None else found & (top > profit + self.fall)
        return found if self.tag is None else found & (F.col("buy_tag") == self.tag)


def exit_rules(p: dict[str, float] = EXIT) -> list[ExitRule]:
    """The reasons in the order in which they are tried, over features of the last three bars (before_, before2_)."""
    c = F.col
    chain = []
    for name, least, under, fall, rsi, more in TRAILS:
        holds = c("rsi") < rsi
        for column, (sign, bound) in more.items():
            holds = holds & (c(column) < bound if sign == "<" else c(column) > bound)
        chain.append(ExitRule(f"sell_profit_{name}", holds, at_least=least, below=under, fall=fall))
    chain.append(ExitRule("sell_profit_t_cti_r_0_1", (c("cti") > p["cti_r_cti"]) & (c("r_14") > p["cti_r_r"]), at_least=0.0, below=0.012))
    for name, column in (("momdiv_1h", "momdiv_sell_1h"), ("momdiv", "momdiv_sell"), ("momdiv_coh", "momdiv_coh")):
        chain.append(ExitRule(f"signal_profit_q_{name}", c(column), above=0.02))
    for name, rsi, flow in (("1", 34.0, 0.0), ("2", 44.0, -0.4)):
        chain.append(ExitRule(f"sell_profit_u_bear_1_{name}", (c("close") < c("ema_200")) & (c("rsi") < rsi) & (c("cmf") < flow), at_least=0.01, below=0.02))
    bear = c("pm") > c("pmax_thresh")
    quick = {"1": c("rsi") > 80.0, "2": c("cti") > 0.95, "pmax_bull": (c("pm") <= c("pmax_thresh")) & (c("close") > c("sma_21") * 1.1), "pmax_bear": bear & (c("close") > c("sma_21") * 1.016)}
    chain += [ExitRule(f"signal_profit_q_{name}", holds, above=0.02, below=0.06) for name, holds in quick.items()]
    lower = (c("ha_high") <= c("before_ha_high")) & (c("before_ha_high") <= c("before2_ha_high")) & (c("ha_close") <= c("before_ha_close"))
    chain.append(ExitRule("sell_scalp", lower & (c("fisher") > 0.39075) & (c("ema_4") > c("ha_close")) & (c("ha_close") * 0.99754 > c("bb_mid")), above=0.0, tag="nfix_39 "))
    stop = (c("close") < c("ema_200") * 0.988) & (c("cmf") < -0.046) & (F.try_divide(c("ema_200") - c("close"), c("close")) < 0.022)
    chain.append(ExitRule("sell_stoploss_u_e_1", stop & (c("rsi") > c("before_rsi")) & (c("rsi") > c("rsi_1h") + 10.0), below=-0.05))
    dead = (c("close") < c("ema_200")) & (c("bb_width") < p["deadfish_bb_width"]) & (c("close") > c("bb_mid") * p["deadfish_bb_factor"])
    chain.append(ExitRule("sell_stoploss_deadfish", dead & (c("volume_mean_12") < c("volume_mean_24") * p["deadfish_volume_factor"]), below=p["deadfish_profit"]))
    return chain


def exit_chain(p: dict[str, float] = EXIT) -> Column:
    """The first reason that holds, of an open trade's bar with ``profit``, ``max_profit``, ``buy_tag`` and features of the last three bars."""
    out = F
    for rule in exit_rules(p):
        out = out.when(rule.of(F.col("profit"), F.col("max_profit")), F.lit(rule.name))
    return F.when(out.isNotNull(), F.concat(out, F.lit("( "), F.coalesce("buy_tag", F.lit("empty")), F.lit(")")))


def held_rules(p: dict[str, float] = EXIT) -> Column:
    """The reasons whose features hold in a bar, whatever a trade's profit and tags: bit k for the k-th."""
    return reduce(lambda a, b: a + b, (F.when(rule.holds, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(exit_rules(p))))


#: Features that the exit chain reads.
EXIT_FEATURES = [
    "close", "high", "rsi", "cmf", "cti", "r_14", "momdiv_sell", "momdiv_coh", "ema_200", "ema_4", "pm", "pmax_thresh", "sma_21", "fisher", "ha_high", "ha_close", "bb_mid", "bb_width", "volume_mean_12", "volume_mean_24",
    "cmf_1h", "cti_1h", "rsi_1h", "r_480_1h", "momdiv_sell_1h",
]
BEFORE = {"before_ha_high": ("ha_high", 1), "before_ha_close": ("ha_close", 1), "before_rsi": ("rsi", 1), "before2_ha_high": ("ha_high", 2)}
DAY_MS = 86_400_000


def with_bars_before(df: DataFrame) -> DataFrame:
    """df with what the exit chain reads of the bars before."""
    return df.withColumns({name: lag(f, k) for name, (f, k) in BEFORE.items()})


def exit_reasons(trades: DataFrame, df: DataFrame, p: dict[str, float] = EXIT) -> DataFrame:
    """Of each trade (symbol, trade_id, open_time, close_time, open_rate, buy_tag) the first bar with a reason to leave: exit_time, exit_reason, exit_rate.

    A bar's profit is that of its close, the highest that of the highest price since the opening. Trades without such a bar are left out."""
    own = with_bars_before(df).select("symbol", "time", *EXIT_FEATURES, *BEFORE)
    d = alive_bars(trades.select("symbol", "trade_id", "open_time", "close_time", "open_rate", "buy_tag"), own, DAY_MS)
    so_far = Window.partitionBy("symbol", "trade_id").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("profit", F.col("close") / F.col("open_rate") - 1).withColumn("max_profit", F.max("high").over(so_far) / F.col("open_rate") - 1)
    hit = d.withColumn("exit_reason", exit_chain(p)).where("exit_reason is not null")
    return hit.groupBy("symbol", "trade_id").agg(F.min("time").alias("exit_time"), F.min_by("exit_reason", "time").alias("exit_reason"), F.min_by("close", "time").alias("exit_rate"))
