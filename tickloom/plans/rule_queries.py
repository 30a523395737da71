"""Queries of the entry rules, their tags and the exit reasons over the hourly candles, with their SQL.

Base and coarse interval are both an hour here, so the coarse columns are those of the same bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import backtest as bt
from tickloom.operators import build, rules
from tickloom.operators import trades as tr
from tickloom.operators.rule_trades import rule_trades as trades_of_rules
from tickloom.plans import registry as reg
from tickloom.plans.registry import BARS, HOUR, HOURLY, full, query


def ema_of(name: str, source: str, x: str, p: int, first: int = 1) -> str:
    """The ema of column x of source (symbol, n), whose values begin at bar ``first``."""
    return f"""{name} AS (SELECT symbol, n, {x} AS s FROM {source} WHERE n = {first} UNION ALL
        SELECT b.symbol, b.n, b.{x} * 2 / ({p} + 1) + {name}.s * (1 - 2.0::DOUBLE / ({p} + 1)) FROM {name} JOIN {source} b ON b.symbol = {name}.symbol AND b.n = {name}.n + 1)"""


def wilder_of(name: str, source: str, x: str, p: int, first: int) -> str:
    return f"""{name} AS (SELECT symbol, {first + p - 1} AS n, avg({x}) AS s FROM {source} WHERE n BETWEEN {first} AND {first + p - 1} GROUP BY 1 HAVING count(*) = {p}
        UNION ALL SELECT b.symbol, b.n, {name}.s + (b.{x} - {name}.s) / {p} FROM {name} JOIN {source} b ON b.symbol = {name}.symbol AND b.n = {name}.n + 1)"""


EMAS = (4, 8, 12, 13, 16, 20, 26, 50, 100, 200)
RSI = {"rsi": ("up", "dn", 14, 2), "rsi_fast": ("up", "dn", 4, 2), "rsi_slow": ("up", "dn", 20, 2), "rsi_15": ("up", "dn", 15, 2), "rsi_3": ("up", "dn", 3, 2), "rsi_s": ("su", "sd", 2, 2), "rmi": ("up4", "dn4", 17, 5)}
_T = "(high + low + close) / 3"
_W20 = "OVER (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING)"
_W25 = "OVER (PARTITION BY symbol ORDER BY time ROWS 24 PRECEDING)"
_FLOW = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"


def strength(up: str, dn: str) -> str:
    return f"CASE WHEN {up}.s + {dn}.s = 0 THEN 50 ELSE 100 * {up}.s / ({up}.s + {dn}.s) END"


def features_sql() -> str:
    ctes = [HOURLY, BARS]
    ctes.append(f"""a1 AS (SELECT *, {_T} AS tp, close - lag(close) OVER w AS c1, close - lag(close, 4) OVER w AS c4, high - lag(high) OVER w AS mu, lag(low) OVER w - low AS md, close - lag(close, 10) OVER w AS mom,
        (open + high + low + close) / 4 AS hac, coalesce(sign(close - lag(close) OVER w), 0) AS sg, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr,
        ({full('avg', '(close * volume)', 96)}) / nullif({full('avg', 'volume', 96)}, 0) AS vw, close - (({full('max', 'high', 20)} + {full('min', 'low', 20)}) / 2 + {full('avg', 'close', 20)}) / 2 AS sq
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time))""")
    ctes.append("""bars2 AS (SELECT *, greatest(c1, 0) + c1 * 0 AS up, greatest(-c1, 0) + c1 * 0 AS dn, greatest(c4, 0) + c4 * 0 AS up4, greatest(-c4, 0) + c4 * 0 AS dn4, greatest(sg - lag(sg) OVER w, 0) AS su, greatest(lag(sg) OVER w - sg, 0) AS sd,
        CASE WHEN mu IS NULL THEN NULL WHEN mu > md AND mu > 0 THEN mu ELSE 0 END AS pdm, CASE WHEN mu IS NULL THEN NULL WHEN md > mu AND md > 0 THEN md ELSE 0 END AS mdm FROM a1 WINDOW w AS (PARTITION BY symbol ORDER BY time))""")
    ctes.append(reg.ema_sql(str([5, *EMAS]), "em"))
    ctes.append("ep AS (SELECT symbol, n, " + ", ".join(f"max(CASE WHEN period = {p} AND n >= {p} THEN s END) AS ema_{p}" for p in EMAS) + " FROM em GROUP BY 1, 2)")
    ctes.append("t1 AS (SELECT symbol, n, s FROM em WHERE period = 5 AND n >= 5)")
    for k in range(2, 7):
        ctes.append(ema_of(f"u{k}", f"t{k - 1}", "s", 5, 4 * (k - 1) + 1))
        ctes.append(f"t{k} AS (SELECT * FROM u{k} WHERE n >= {4 * k + 1})")
    ctes += [ema_of("th", "bars2", "hac", 9), ema_of("vwe", "bars2", "vw", 96, 96)]
    for name, (up, dn, p, first) in RSI.items():
        ctes += [wilder_of(f"{name}_u", "bars2", up, p, first), wilder_of(f"{name}_d", "bars2", dn, p, first)]
    ctes += [wilder_of(f"w_{x}", "bars2", x, 14, 2) for x in ("tr", "pdm", "mdm")]
    ctes.append("dxs AS (SELECT t.symbol, t.n, coalesce(100 * abs(p.s / nullif(t.s, 0) - m.s / nullif(t.s, 0)) / nullif(p.s / nullif(t.s, 0) + m.s / nullif(t.s, 0), 0), 0) AS dx FROM w_tr t JOIN w_pdm p USING (symbol, n) JOIN w_mdm m USING (symbol, n))")
    ctes.append(wilder_of("adxs", "dxs", "dx", 14, 15))
    ctes.append("""ha AS (SELECT symbol, n, (open + close) / 2 AS ho, hac AS hc FROM bars2 WHERE n = 1 UNION ALL SELECT b.symbol, b.n, (ha.ho + ha.hc) / 2, b.hac FROM ha JOIN bars2 b ON b.symbol = ha.symbol AND b.n = ha.n + 1)""")
    ctes.append("hb AS (SELECT b.symbol, b.time, n, ho, hc, greatest(high, ho, hc) AS hh, least(low, ho, hc) AS hl FROM bars2 b JOIN ha USING (symbol, n))")
    ctes.append("""hx AS (SELECT *, (ho + hc + hh + hl) / 4 AS x, (hh + hl + hc) / 3 AS htp, CASE WHEN lag(hc) OVER w IS NOT NULL THEN greatest(hh - hl, abs(hh - lag(hc) OVER w), abs(hl - lag(hc) OVER w)) END AS htr FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY time))""")
    ctes += [ema_of("hm", "hx", "x", 9), wilder_of("hatr", "hx", "htr", 10, 2)]
    ctes.append("m AS (SELECT hx.symbol, hx.n, CASE WHEN hx.n >= 9 THEN hm.s END AS ma, 2.7 * hatr.s AS wide FROM hx JOIN hm USING (symbol, n) LEFT JOIN hatr USING (symbol, n))")
    ctes.append("""l AS (SELECT symbol, n, ma, 0::DOUBLE AS top, 0::DOUBLE AS bottom, true AS upper FROM m WHERE n = 10 UNION ALL
        SELECT symbol, n, ma, t, b, CASE WHEN upper THEN ma <= t ELSE NOT ma >= b END FROM (
            SELECT m.symbol, m.n, m.ma, l.upper, CASE WHEN m.ma + m.wide < l.top OR l.ma > l.top THEN m.ma + m.wide ELSE l.top END AS t, CASE WHEN m.ma - m.wide > l.bottom OR l.ma < l.bottom THEN m.ma - m.wide ELSE l.bottom END AS b
            FROM l JOIN m ON m.symbol = l.symbol AND m.n = l.n + 1))""")
    left = " ".join(f"LEFT JOIN {name}_u USING (symbol, n) LEFT JOIN {name}_d USING (symbol, n)" for name in RSI)
    rsis = ", ".join(f"{strength(f'{name}_u', f'{name}_d')} AS {name}" for name in RSI)
    means = ", ".join(f"{full('avg', 'volume', k, -1)} AS volume_mean_{k}" for k in (4, 12, 24)) + ", " + ", ".join(f"{full('avg', 'close', k)} AS sma_{k}" for k in (15, 21, 28, 30, 75))
    b = 0.7
    t3 = " + ".join(f"({w!r}) * t{6 - k}.s" for k, w in enumerate((-(b**3), 3 * b * b + 3 * b**3, -6 * b * b - 3 * b - 3 * b**3, 1 + 3 * b + b**3 + 3 * b * b)))
    ctes.append(f"""v1 AS (SELECT *, {full('avg', 'tp', 20)} AS bb_mid, {full('stddev_samp', 'tp', 20)} AS bsd, {full('avg', 'mom', 20)} AS mm, {full('stddev_pop', 'mom', 20)} AS ms, {means}, {full('avg', 'tr', 28)} AS tr28,
        sum({_FLOW}) {_W20} / nullif(sum(volume) {_W20}, 0) AS cmf, -100 * ({full('max', 'high', 14)} - close) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) AS r_14,
        -100 * ({full('max', 'high', 480)} - close) / nullif({full('max', 'high', 480)} - {full('min', 'low', 480)}, 0) AS r_480, CASE WHEN n >= 20 THEN corr(close, n) {_W20} END AS cti,
        CASE WHEN n >= 25 THEN avg(tp) {_W25} END AS cm, list(tp) {_W25} AS cl, (close - {full('min', 'low', 5)}) / nullif({full('max', 'high', 5)} - {full('min', 'low', 5)}, 0) * 100 AS fastk, {full('max', 'high', 30)} AS h30,
        ({full('max', 'high', 5)} - {full('min', 'low', 5)}) / nullif({full('min', 'low', 5)}, 0) AS hl5, {full('min', 'low', 5, -1)} AS low_5, CASE WHEN count(sq) {_W20} = 20 THEN regr_slope(sq, n) {_W20} * n + regr_intercept(sq, n) {_W20} END AS linreg,
        (close / lag(close, 9) OVER w - 1) * 100 AS roc, (close / lag(close, 100) OVER w - 1) * 100 AS roc100, hac / lag(hac, 168) OVER w AS rocr_168, abs(hac - lag(hac) OVER w) AS ha_closedelta, abs(c1) AS closedelta
        FROM bars2 WINDOW w AS (PARTITION BY symbol ORDER BY time))""")
    ctes.append(f"""v2 AS (SELECT v1.*, ep.* EXCLUDE (symbol, n), {rsis}, adxs.s AS adx, CASE WHEN v1.n >= 9 THEN th.s END AS pmax_thresh, CASE WHEN v1.n >= 191 THEN vwe.s END AS vwe, {t3} AS t3, ho, hh AS ha_high, hl AS ha_low, htp,
        CASE WHEN v1.n <= 10 THEN 0 WHEN upper THEN top ELSE bottom END AS pm, {full('avg', 'fastk', 3)} AS fastd
        FROM v1 JOIN ep USING (symbol, n) {left} LEFT JOIN adxs USING (symbol, n) LEFT JOIN th USING (symbol, n) LEFT JOIN vwe USING (symbol, n) LEFT JOIN t3 USING (symbol, n) LEFT JOIN t4 USING (symbol, n) LEFT JOIN t5 USING (symbol, n)
        LEFT JOIN t6 USING (symbol, n) JOIN hx USING (symbol, n) LEFT JOIN l USING (symbol, n))""".replace("OVER (PARTITION BY symbol ORDER BY time", "OVER (PARTITION BY v1.symbol ORDER BY v1.time"))
    ctes.append(f"""v3 AS (SELECT * EXCLUDE (ho, hc_), (rsi_15 - {full('min', 'rsi_15', 20)}) / nullif({full('max', 'rsi_15', 20)} - {full('min', 'rsi_15', 20)}, 0) * 100 AS srsi_k, (rsi_3 + rsi_s + roc100) / 3 AS crsi,
        (ema_50 - ema_200) / nullif(low, 0) * 100 AS ewo, coalesce(vwe >= lag(vwe) OVER w, false) AS moderi, (exp(0.2 * (rsi - 50)) - 1) / (exp(0.2 * (rsi - 50)) + 1) AS fisher, abs(hac - ha_low) AS tail,
        {full('avg', 'htp', 40)} - 2 * {full('stddev_samp', 'htp', 40)} AS bbh_low, 2 * {full('stddev_samp', 'htp', 40)} AS bb_delta_cluc, bb_mid - 2 * bsd AS bb_low, bb_mid + 2 * bsd AS bb_up, bb_mid - 3 * bsd AS bb3_low,
        4 * bsd / nullif(bb_mid, 0) AS bb_width, bsd / nullif(bb_mid - 2 * bsd, 0) AS bb_delta, sma_28 - tr28 AS kc_low, sma_28 + tr28 AS kc_up, (tp - cm) / nullif(0.015 * list_avg(list_transform(cl, lambda y: abs(y - cm))), 0) AS cci,
        coalesce(mom > mm + 2 * ms AND lag(mom) OVER w <= lag(mm + 2 * ms) OVER w, false) AS momdiv_sell, coalesce(high >= h30, false) AS momdiv_coh, coalesce(hl5 < 0.66 OR close < low_5 OR close > open, close > open, false) AS safe_dump
        FROM (SELECT *, 0 AS hc_ FROM v2) WINDOW w AS (PARTITION BY symbol ORDER BY time))""")
    return ", ".join(ctes)


_L = "lag({}, {}) OVER w"


def lagged(x: str, k: int = 1) -> str:
    return _L.format(x, k)


_RISE = f"ema_200 > {lagged('ema_200', 12)} AND {lagged('ema_200', 12)} > {lagged('ema_200', 24)}"
_GAP = "(ema_26 - ema_12)"
RULES_SQL = {
    "bb": "rmi < 49 AND cci <= -116 AND srsi_k < 32 AND bb_delta > 0.025 AND bb_width > 0.095 AND closedelta > close * 17.922 / 1000 AND close < bb3_low * 0.999",
    "local_uptrend": f"ema_26 > ema_12 AND {_GAP} > open * 0.026 AND {lagged(_GAP)} > open / 100 AND close < bb_low * 0.999 AND closedelta > close * 17.922 / 1000",
    "local_dip": f"ema_26 > ema_12 AND {_GAP} > open * 0.024 AND {lagged(_GAP)} > open / 100 AND close < ema_20 * 1.014 AND rsi < 21 AND crsi > 10 AND closedelta > close * 12.044 / 1000",
    "ewo": "rsi_fast < 44 AND close < ema_8 * 0.935 AND ewo > -5.001 AND close < ema_16 * 0.968 AND rsi < 23",
    "ewo2": f"{_RISE} AND rsi_fast < 45 AND close < ema_8 * 0.970 AND ewo > 4.179 AND close < ema_16 * 1.087 AND rsi < 35",
    "r_deadfish": "ema_100 < ema_200 * 1.054 AND bb_width > 0.299 AND close < bb_mid * 1.014 AND volume_mean_12 > volume_mean_24 * 1.59 AND cti < -0.115 AND r_14 < -44.34",
    "clucHA": f"rocr_168 > 0.526 AND {lagged('bbh_low')} > 0 AND bb_delta_cluc > hac * 0.049 AND ha_closedelta > hac * 0.017 AND tail < bb_delta_cluc * 1.146 AND hac < {lagged('bbh_low')} AND hac < {lagged('hac')}",
    "cofi": f"open < ema_8 * 1.147 AND fastk > fastd AND {lagged('fastk')} <= {lagged('fastd')} AND fastk < 39 AND fastd < 28 AND adx > 13 AND ewo > 8.594 AND cti < -0.892 AND r_14 < -85.016",
    "gumbo": "ewo < -9.442 AND bb_mid >= t3 AND t3 <= ema_8 * 1.121 AND cti < -0.374 AND r_14 < -51.971",
    "sqzmom": f"bb_low < kc_low AND bb_up > kc_up AND {lagged('linreg', 2)} > {lagged('linreg')} AND {lagged('linreg')} < linreg AND linreg < 0 AND close < ema_13 * 0.981 AND ewo < -3.966 AND r_14 < -45.068",
    "nfi_13": "ema_50 > ema_100 AND close < sma_30 * 0.99 AND cti < -0.92 AND ewo < -5.585 AND cti < -0.88 AND crsi > 10",
    "nfi_32": f"rsi_slow < {lagged('rsi_slow')} AND rsi_fast < 46 AND rsi > 25 AND close < sma_15 * 0.93 AND cti < -0.9",
    "nfi_33": "close < ema_13 * 0.978 AND ewo > 8 AND cti < -0.88 AND rsi < 32 AND r_14 < -98 AND volume < volume_mean_4 * 2.5",
    "nfi_38": "pm > pmax_thresh AND close < sma_75 * 0.98 AND ewo < -4.4 AND cti < -0.95 AND r_14 < -97 AND crsi > 0.5",
    "nfix_5": f"{_RISE} AND close < sma_75 * 0.932 AND ewo > 3.6 AND cti < -0.9 AND r_14 < -97",
    "nfix_39": f"{_RISE} AND {lagged('bbh_low')} > 0 AND bb_delta_cluc > close * 0.056 AND closedelta > close * 0.01 AND tail < bb_delta_cluc * 0.5 AND close < {lagged('bbh_low')} AND close <= {lagged('close')} AND close > ema_13 * 0.912",
    "nfix_49": f"{lagged(_GAP, 3)} > 0 AND {lagged(_GAP, 3)} > {lagged('open', 3)} * 0.032 AND {lagged(_GAP, 9)} > {lagged('open', 3)} / 100 AND {lagged('close', 3)} < {lagged('ema_20', 3)} * 0.916 AND {lagged('rsi', 3)} < 32.5 AND {lagged('crsi', 3)} > 18 AND cti < -0.105 AND r_14 < -81.827",
    "nfi7_33": "moderi AND cti < -0.88 AND close < ema_13 * 0.988 AND ewo > 6.4 AND rsi < 32 AND volume < volume_mean_4 * 2.0",
    "nfi7_37": "pm > pmax_thresh AND close < sma_75 * 0.98 AND ewo > 9.8 AND rsi < 56 AND cti < -0.7 AND safe_dump",
}
_FEATURES = features_sql()
_RULES = f"{_FEATURES}, ru AS (SELECT *, {', '.join(f'coalesce({x}, false) AS rule_{t}' for t, x in RULES_SQL.items())} FROM v3 WINDOW w AS (PARTITION BY symbol ORDER BY time))"
_TAGGED = f"{_RULES}, tg AS (SELECT *, {' || '.join(f'CASE WHEN rule_{t} THEN {t + chr(32)!r} ELSE {chr(39) * 2} END' for t in RULES_SQL)} AS buy_tag, CASE WHEN roc < 86 AND bb_width < 0.954 AND ({' OR '.join(f'rule_{t}' for t in RULES_SQL)}) THEN 1 END AS enter_long FROM ru)"


def ruled(candles: DataFrame) -> DataFrame:
    d = rules.features(candles)
    return rules.with_rules(rules.with_coarse(d, d, HOUR, HOUR))


#: Features that are compared one by one: Spark's name, SQL's name.
SHOWN = {
    "rmi": "rmi", "cci": "cci", "srsi_k": "srsi_k", "bb3_low": "bb3_low", "ema_100": "ema_100", "rsi_fast": "rsi_fast", "rsi_slow": "rsi_slow", "crsi": "crsi", "ewo": "ewo", "cti": "cti", "r_480": "r_480", "fastd": "fastd", "adx": "adx",
    "t3": "t3", "pm": "pm", "pmax_thresh": "pmax_thresh", "bbh_low": "bbh_low", "bb_delta_cluc": "bb_delta_cluc", "tail": "tail", "rocr_168": "rocr_168", "ha_closedelta": "ha_closedelta", "kc_low_28": "kc_low",
    "fisher": "fisher", "cmf": "cmf", "roc": "roc", "volume_mean_24": "volume_mean_24",
}


@query("entry_features", f"WITH RECURSIVE {_FEATURES} SELECT symbol, time, moderi, momdiv_sell, momdiv_coh, safe_dump, {', '.join(f'round({b}, 4) AS {a}' for a, b in SHOWN.items())} FROM v3", 4)
def entry_features(spark, sf_dir):
    """The indicators that the rules read (I1-I36)."""
    return rules.features(reg.hourly(spark, sf_dir)).select("symbol", "time", "moderi", "momdiv_sell", "momdiv_coh", "safe_dump", *SHOWN)


@query("entry_rules", f"WITH RECURSIVE {_RULES} SELECT symbol, time, {', '.join(f'rule_{t}' for t in RULES_SQL)} FROM ru")
def entry_rules(spark, sf_dir):
    """R3."""
    return ruled(reg.hourly(spark, sf_dir)).select("symbol", "time", *[f"rule_{t}" for t in rules.TAGS])


def tagged(spark, sf_dir) -> DataFrame:
    return tagged_of(reg.hourly(spark, sf_dir))


def tagged_of(candles: DataFrame) -> DataFrame:
    return ruled(candles).withColumn("buy_tag", rules.entry_tags()).withColumn("enter_long", rules.enter_long())


@query("entry_tags", f"WITH RECURSIVE {_TAGGED} SELECT symbol, time, buy_tag FROM tg")
def entry_tags(spark, sf_dir):
    """R4."""
    return tagged(spark, sf_dir).select("symbol", "time", "buy_tag")


@query("enter_long", f"WITH RECURSIVE {_TAGGED} SELECT symbol, CAST(coalesce(sum(enter_long), 0) AS BIGINT) AS entries, count(*) AS bars FROM tg GROUP BY 1")
def enter_long(spark, sf_dir):
    """R5: how often each symbol is entered."""
    return tagged(spark, sf_dir).groupBy("symbol").agg(F.coalesce(F.sum("enter_long"), F.lit(0)).cast("long").alias("entries"), F.count("*").alias("bars"))


_BANDS = [
    ("sell_profit_t_0_1", "p >= 0 AND p < 0.012 AND mp > p + 0.045 AND rsi < 46"), ("sell_profit_t_0_2", "p >= 0 AND p < 0.012 AND mp > p + 0.025 AND rsi < 32"), ("sell_profit_t_0_3", "p >= 0 AND p < 0.012 AND mp > p + 0.05 AND rsi < 48"),
    ("sell_profit_t_1_1", "p >= 0.012 AND p < 0.02 AND mp > p + 0.01 AND rsi < 39"), ("sell_profit_t_1_2", "p >= 0.012 AND p < 0.02 AND mp > p + 0.035 AND rsi < 45 AND cmf < 0"),
    ("sell_profit_t_1_4", "p >= 0.012 AND p < 0.02 AND mp > p + 0.02 AND rsi < 40 AND cmf < 0 AND cti > 0.8"), ("sell_profit_t_1_5", "p >= 0.012 AND p < 0.02 AND mp > p + 0.04 AND rsi < 49 AND cmf < 0"),
    ("sell_profit_t_1_7", "p >= 0.012 AND p < 0.02 AND mp > p + 0.06 AND rsi < 43 AND cmf < 0"), ("sell_profit_t_1_9", "p >= 0.012 AND p < 0.02 AND mp > p + 0.025 AND rsi < 40 AND cmf < -0.1 AND rsi < 50"),
    ("sell_profit_t_1_10", "p >= 0.012 AND p < 0.02 AND mp > p + 0.025 AND rsi < 46 AND cmf < 0 AND r_480 > -20"), ("sell_profit_t_1_11", "p >= 0.012 AND p < 0.02 AND mp > p + 0.025 AND rsi < 42"),
    ("sell_profit_t_1_12", "p >= 0.012 AND p < 0.02 AND mp > p + 0.01 AND rsi < 44 AND cmf < -0.25"),
    ("sell_profit_t_cti_r_0_1", "p >= 0 AND p < 0.012 AND cti > 0.844 AND r_14 > -19.99"), ("signal_profit_q_momdiv_1h", "p > 0.02 AND momdiv_sell"), ("signal_profit_q_momdiv", "p > 0.02 AND momdiv_sell"),
    ("signal_profit_q_momdiv_coh", "p > 0.02 AND momdiv_coh"), ("sell_profit_u_bear_1_1", "close < ema_200 AND p >= 0.01 AND p < 0.02 AND rsi < 34 AND cmf < 0"),
    ("sell_profit_u_bear_1_2", "close < ema_200 AND p >= 0.01 AND p < 0.02 AND rsi < 44 AND cmf < -0.4"), ("signal_profit_q_1", "p > 0.02 AND p < 0.06 AND rsi > 80"), ("signal_profit_q_2", "p > 0.02 AND p < 0.06 AND cti > 0.95"),
    ("signal_profit_q_pmax_bull", "p > 0.02 AND p < 0.06 AND pm <= pmax_thresh AND close > sma_21 * 1.1"), ("signal_profit_q_pmax_bear", "p > 0.02 AND p < 0.06 AND pm > pmax_thresh AND close > sma_21 * 1.016"),
    ("sell_scalp", "p > 0 AND tag = 'nfix_39 ' AND fisher > 0.39075 AND ha_high <= hh1 AND hh1 <= hh2 AND hac <= hc1 AND ema_4 > hac AND hac * 0.99754 > bb_mid"),
    ("sell_stoploss_u_e_1", "p < -0.05 AND close < ema_200 * 0.988 AND cmf < -0.046 AND (ema_200 - close) / close < 0.022 AND rsi > r1 AND rsi > rsi + 10"),
    ("sell_stoploss_deadfish", "p < -0.063 AND close < ema_200 AND bb_width < 0.043 AND close > bb_mid * 0.954 AND volume_mean_12 < volume_mean_24 * 2.37"),
]
_REASONS = f"""{reg._TRADES.removeprefix(f"{HOURLY}, {BARS}, ")},
    lg AS (SELECT *, lag(ha_high) OVER w AS hh1, lag(ha_high, 2) OVER w AS hh2, lag(hac) OVER w AS hc1, lag(rsi) OVER w AS r1, lag(buy_tag) OVER w AS tag_before FROM tg WINDOW w AS (PARTITION BY symbol ORDER BY time)),
    ta AS (SELECT c.symbol, trade_id, open_time, close_time, open_rate, nullif(b.tag_before, '') AS tag FROM closed c JOIN lg b ON b.symbol = c.symbol AND b.time = c.open_time),
    al AS (SELECT lg.*, ta.trade_id, ta.tag, lg.close / open_rate - 1 AS p, max(lg.high) OVER (PARTITION BY ta.symbol, trade_id ORDER BY lg.time) / open_rate - 1 AS mp FROM ta JOIN lg ON lg.symbol = ta.symbol AND lg.time BETWEEN open_time AND close_time),
    ex AS (SELECT symbol, trade_id, time, close, coalesce(tag, 'empty') AS tag, CASE {' '.join(f"WHEN {x} THEN '{n}'" for n, x in _BANDS)} END AS reason FROM al),
    er AS (SELECT symbol, trade_id, min(time) AS exit_time, arg_min(reason || '( ' || tag || ')', time) AS exit_reason, arg_min(close, time) AS exit_rate FROM ex WHERE reason IS NOT NULL GROUP BY 1, 2)"""


def reasons(spark, sf_dir) -> DataFrame:
    """The trades of one pair of averages, tagged by the rules of the bar before they open."""
    d = tagged(spark, sf_dir)
    tags = d.select("symbol", "time", F.nullif(rules.lag("buy_tag"), F.lit("")).alias("buy_tag"))
    trades = reg.closed(spark, sf_dir).withColumn("time", F.col("open_time")).join(tags, ["symbol", "time"]).drop("time")
    return rules.exit_reasons(trades, d)


@query("exit_reasons", f"WITH RECURSIVE {_TAGGED}, {_REASONS} SELECT symbol, trade_id, exit_time, exit_reason, round(exit_rate, 4) AS exit_rate FROM er", 4)
def exit_reasons(spark, sf_dir):
    """R7."""
    return reasons(spark, sf_dir)


@query("exit_reason_counts", f"WITH RECURSIVE {_TAGGED}, {_REASONS} SELECT symbol, exit_reason, count(*) AS n FROM er GROUP BY 1, 2")
def exit_reason_counts(spark, sf_dir):
    """A7 over the reasons of the exit chain."""
    return tr.exit_counts(reasons(spark, sf_dir))


# Trades that the rules open and the first exit closes

_STOP_FAR = "CASE WHEN p > 0.2 THEN 0.05 WHEN p > 0.1 THEN 0.03 WHEN p > 0.06 THEN 0.02 WHEN p > 0.03 THEN 0.015 END"
_RULE_TRADES = f"""lg AS (SELECT *, lag(ha_high) OVER w AS hh1, lag(ha_high, 2) OVER w AS hh2, lag(hac) OVER w AS hc1, lag(rsi) OVER w AS r1, coalesce(enter_long = 1, false) AS sig, nullif(buy_tag, '') AS own_tag FROM tg WINDOW w AS (PARTITION BY symbol ORDER BY time)),
    st AS (SELECT symbol, n, false AS was_open, sig AS pending, own_tag AS tag, 0::BIGINT AS ot, 0::DOUBLE AS orate, 0::DOUBLE AS top, 0::DOUBLE AS stop, false AS ended, ''::VARCHAR AS why, 0::DOUBLE AS rate, 0::BIGINT AS ct FROM lg WHERE n = 1
        UNION ALL SELECT symbol, n, is_open AND NOT ends, sig AND (ends OR NOT is_open), CASE WHEN sig AND (ends OR NOT is_open) THEN own_tag ELSE tag END, ot, orate, top,
            CASE WHEN far IS NULL THEN stop ELSE greatest(stop, close * (1 - far)) END, is_open AND ends, CASE WHEN low <= stop THEN 'trailing_stop' WHEN reason IS NOT NULL THEN reason || '( ' || coalesce(tag, 'empty') || ')' ELSE 'take_profit' END || '|' || coalesce(tag, ''), CASE WHEN low <= stop THEN stop ELSE close END, time
        FROM (SELECT *, coalesce(low <= stop OR reason IS NOT NULL OR p >= wanted, false) AS ends FROM (SELECT *, CASE {' '.join(f"WHEN {x} THEN '{n}'" for n, x in _BANDS)} END AS reason, {_STOP_FAR} AS far, CASE WHEN time - ot >= 292 * 60000 THEN 0.005 WHEN time - ot >= 81 * 60000 THEN 0.038 ELSE 0.205 END AS wanted
            FROM (SELECT *, close / orate - 1 AS p, top / orate - 1 AS mp FROM (SELECT lg.*, s.tag, s.was_open OR (s.pending AND lg.open > 0) AS is_open, CASE WHEN s.was_open THEN s.ot ELSE lg.time END AS ot, CASE WHEN s.was_open THEN s.orate ELSE lg.open END AS orate,
                CASE WHEN s.was_open THEN greatest(s.top, lg.high) ELSE lg.high END AS top, CASE WHEN s.was_open THEN s.stop ELSE lg.open * (1 - 0.99) END AS stop FROM st s JOIN lg ON lg.symbol = s.symbol AND lg.n = s.n + 1))))),
    rt AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY n) AS trade_id, ot AS open_time, ct AS close_time, orate AS open_rate, rate AS close_rate, nullif(split_part(why, '|', 2), '') AS buy_tag, split_part(why, '|', 1) AS exit_reason,
        {(1 - reg.FEE) * (1 - reg.FEE)!r} * rate / orate - 1 AS profit_ratio, 100 * ({(1 - reg.FEE) * (1 - reg.FEE)!r} * rate / orate - 1) AS profit_abs FROM st WHERE ended)"""


def calmed(sql: str) -> str:
    return f"WITH RECURSIVE {sql}".replace("value AS price", "245 + 0.3 * (value - 245) AS price")


def calm(spark, sf_dir) -> DataFrame:
    """Hourly candles of prices with three tenths of the given ones' swings, in which rules find entries."""
    return build.build_candles(reg.ticks(spark, sf_dir).withColumn("price", 245 + 0.3 * (F.col("price") - 245)), "1h")


def of_rules(spark, sf_dir) -> DataFrame:
    return trades_of_rules(tagged_of(calm(spark, sf_dir)), reg.FEE, 100.0)


@query("rule_trades", calmed(f"{_TAGGED}, {_RULE_TRADES} SELECT symbol, trade_id, open_time, close_time, round(open_rate, 4) AS open_rate, round(close_rate, 4) AS close_rate, buy_tag, exit_reason, round(profit_ratio, 4) AS profit_ratio FROM rt"), 4)
def rule_trades(spark, sf_dir):
    """R5, R7-R9 to B9."""
    return of_rules(spark, sf_dir).drop("level", "profit_abs")


@query("rule_exit_counts", calmed(f"{_TAGGED}, {_RULE_TRADES} SELECT symbol, exit_reason, count(*) AS n FROM rt GROUP BY 1, 2"))
def rule_exit_counts(spark, sf_dir):
    """A7 over the trades of the rules."""
    return tr.exit_counts(of_rules(spark, sf_dir))


@query("rule_win_stats", calmed(f"{_TAGGED}, {_RULE_TRADES} SELECT symbol, count(*) AS trades, count(*) FILTER (profit_ratio > 0) AS wins, round(sum(profit_abs), 4) AS profit, round(count(*) FILTER (profit_ratio > 0)::DOUBLE / count(*), 4) AS win_rate FROM rt GROUP BY 1"), 4)
def rule_win_stats(spark, sf_dir):
    """A4 over the trades of the rules."""
    return tr.win_stats(of_rules(spark, sf_dir), ["symbol"])


_SHOWN = "count(*) AS trades, round(avg(profit_ratio), 4) AS mean_profit, round(sum(profit_abs), 4) AS profit, round(count(*) FILTER (profit_ratio > 0)::DOUBLE / nullif(count(*), 0), 4) AS win_rate"


@query("strategy_comparison", calmed(f"{_TAGGED}, {_RULE_TRADES}, {reg._TRADES.removeprefix(f'{HOURLY}, {BARS}, ')} SELECT 'rules' AS strategy, {_SHOWN} FROM rt UNION ALL SELECT 'double_ema' AS strategy, {_SHOWN} FROM closed"), 4)
def strategy_comparison(spark, sf_dir):
    """A11: the rules' trades beside those of one pair of averages."""
    return tr.compare_strategies({"rules": of_rules(spark, sf_dir), "double_ema": reg.closed_of(calm(spark, sf_dir))})


# Single indicators that the rules' SQL has too

for _name, _columns in (("moderi", "moderi AS moderi_96"), ("crsi", "round(crsi, 6) AS crsi"), ("stochastic_rsi", "round(srsi_k, 6) AS srsi_k, round((2 * srsi_k + lag(srsi_k) OVER w) / 3, 6) AS srsi_d"), ("adx", "round(adx, 6) AS adx"), ("t3", "round(t3, 6) AS t3")):
    reg.ORACLE_SQL[_name] = f"WITH RECURSIVE {_FEATURES} SELECT symbol, time, {_columns} FROM v3 WINDOW w AS (PARTITION BY symbol ORDER BY time)"
_W9 = "OVER (PARTITION BY symbol ORDER BY time ROWS 8 PRECEDING)"
reg.ORACLE_SQL["moving_averages"] = f"""WITH RECURSIVE {HOURLY}, {BARS}, {ema_of('e1', 'bars', 'close', 9)}, f1 AS (SELECT * FROM e1 WHERE n >= 9), {ema_of('e2', 'f1', 's', 9, 9)}, f2 AS (SELECT * FROM e2 WHERE n >= 17), {ema_of('e3', 'f2', 's', 9, 17)}, f3 AS (SELECT * FROM e3 WHERE n >= 25),
    r AS (SELECT bars.*, f1.s AS a, f2.s AS b, f3.s AS c, list(close) {_W9} AS l FROM bars LEFT JOIN f1 USING (symbol, n) LEFT JOIN f2 USING (symbol, n) LEFT JOIN f3 USING (symbol, n))
    SELECT symbol, time, round(2 * a - b, 6) AS dema, round(3 * a - 3 * b + c, 6) AS tema, CASE WHEN n >= 9 THEN round(list_sum(list_transform(l, lambda x, i: x * i)) / 45, 6) END AS wma FROM r""".replace("list(close) OVER (PARTITION BY symbol ORDER BY time", "list(close) OVER (PARTITION BY bars.symbol ORDER BY bars.time")


def scored(signal: str, params: str, source: str, level: str = "1h", per_year: int = 8760, best: bool = True) -> str:
    """SQL of the scores of runs with a signal, by params, from bars joined with averages; of each series the best, or all."""
    part = f"PARTITION BY symbol, {params} ORDER BY n"
    return f"""s AS (SELECT b.*, {source}), k AS (SELECT *, last_value({signal} IGNORE NULLS) OVER ({part}) AS kept FROM s), h AS (SELECT *, coalesce(lag(kept) OVER ({part}), 0) AS held FROM k),
    g AS (SELECT *, coalesce(lag(held) OVER ({part}), 0) AS was, lag(close) OVER ({part}) AS pc FROM h),
    f2 AS (SELECT *, CASE WHEN held = 1 AND was = 0 THEN (1 - {reg.FEE}) * close / open WHEN held = 0 AND was = 1 THEN (1 - {reg.FEE}) * open / pc WHEN held = 1 THEN close / pc ELSE 1 END AS factor FROM g),
    v AS (SELECT *, sum(ln(factor)) OVER ({part}) + ln({reg.CAPITAL}) AS value FROM f2), q AS (SELECT *, max(value) OVER ({part}) AS peak, CASE WHEN n > 1 THEN factor - 1 END AS ret FROM v),
    scores AS (SELECT symbol, '{level}' AS level, {params}, arg_max(value, n) AS log_final, max(1 - exp(value - peak)) * 100 AS max_dd, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt({per_year}) ELSE 0 END AS sharpe, count(*) AS bars FROM q GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, log_final DESC, {params}) AS rank FROM scores)
    SELECT symbol, level, {params}, round(log_final, 4) AS log_final, round(max_dd, 4) AS max_dd, round(sharpe, 4) AS sharpe, bars{', rank::INT AS rank FROM ranked WHERE rank = 1' if best else ' FROM scores'}"""


reg.ORACLE_SQL["sweep_single_best"] = f"WITH RECURSIVE {HOURLY}, {BARS}, {reg.ema_sql('range(5, 25)')}, " + scored(
    "CASE WHEN n >= period THEN CASE WHEN close > a THEN 1 WHEN close < a THEN 0 END END", "period", "e.period::INT AS period, e.s AS a FROM bars b JOIN e USING (symbol, n)"
)
_F32 = BARS.replace("SELECT *,", "SELECT symbol, level, time, open::FLOAT::DOUBLE AS open, close::FLOAT::DOUBLE AS close,")
reg.ORACLE_SQL["sweep_single_precision"] = f"WITH RECURSIVE {HOURLY}, {_F32}, {reg.ema_sql('range(3, 13)')}, p AS (SELECT f.range::INT AS fast, l.range::INT AS slow FROM range(3, 13) f, range(4, 13) l WHERE l.range > f.range), " + scored(
    "CASE WHEN n >= slow THEN CASE WHEN x > y THEN 1 WHEN x < y THEN 0 END END", "fast, slow", "fast, slow, f.s AS x, l.s AS y FROM p JOIN e f ON f.period = p.fast JOIN e l ON l.period = p.slow AND l.symbol = f.symbol AND l.n = f.n JOIN bars b ON b.symbol = f.symbol AND b.n = f.n"
)

_QUARTERS = f"{reg.TICKS}, {reg.candles_sql('15m', 'CAST(epoch_ms(ts) AS BIGINT) // 900000 * 900000')}"


@query(
    "sweep_15m",
    f"WITH RECURSIVE {_QUARTERS}, {BARS}, {reg.ema_sql('range(3, 13)')}, p AS (SELECT f.range::INT AS fast, l.range::INT AS slow FROM range(3, 13) f, range(4, 13) l WHERE l.range > f.range), "
    + scored(
        "CASE WHEN n >= slow THEN CASE WHEN x > y THEN 1 WHEN x < y THEN 0 END END", "fast, slow", "fast, slow, f.s AS x, l.s AS y FROM p JOIN e f ON f.period = p.fast JOIN e l ON l.period = p.slow AND l.symbol = f.symbol AND l.n = f.n JOIN bars b ON b.symbol = f.symbol AND b.n = f.n",
        "15m", 35040, best=False,
    ),
    4,
)
def sweep_15m(spark, sf_dir):
    """P3, P9 on 15-minute candles."""
    return reg.in_logs(reg.scored(build.build_candles(reg.ticks(spark, sf_dir), "15m"), reg.GRID, "15m"))
