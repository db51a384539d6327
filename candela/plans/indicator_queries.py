"""Indicator queries on hourly bars per event type."""

from __future__ import annotations

import math

from candela.operators import indicators as ind
from candela.plans.registry import query
from candela.plans.sqltext import BARS, OVER, div, ema, flag, full, lag, pct, pick, rounded, stages
from candela.functions.series import bar_series
from candela.sources.driver_tables import event_bars

KEYS = ["symbol", "ts"]
S252 = repr(math.sqrt(252))


def register(name, indicator, cols, ctes=(), source=None, digits=6):
    """One query: run ``indicator`` on event bars, keep the listed columns."""
    ctes = [BARS, *ctes]
    source = source or ctes[-1].split(" AS ")[0]

    @query(name, pick(ctes, source, KEYS, cols, digits))
    def run(spark, sf_dir):
        return rounded(indicator(event_bars(spark, sf_dir)).select(*KEYS, *cols), digits)


MINUTE_BARS = BARS.replace("'hour'", "'minute'")


def register_minutes(name, indicator, cols, ctes=(), digits=6):
    """The same on minute bars in chunks of 512 rows, so that every series crosses several chunks."""
    ctes = [MINUTE_BARS, *ctes]

    @query(name, pick(ctes, ctes[-1].split(" AS ")[0], KEYS, cols, digits))
    def run(spark, sf_dir):
        out = indicator(event_bars(spark, sf_dir, "M1"), bar_series(60, chunk_rows=512))
        return rounded(out.select(*KEYS, *cols), digits)


RET = f"ret AS (SELECT *, {pct('close', lag('close'))} AS returns FROM bars)"
TR = (
    f"tr AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,"
    f" {lag('close')} AS pc FROM bars)"
)


def with_returns(*parts):
    return ind.chain(ind.returns(), *parts)


register("d01_sma", ind.sma((10, 20, 50, 200)), {f"sma_{n}": "d:" + full(n, "close") for n in (10, 20, 50, 200)})
register("d02_ema", ind.ema((12, 26, 50)), {f"ema_{n}": "d:" + ema(n, "close") for n in (12, 26, 50)})
register_minutes("d02_ema_minutes", ind.ema((12, 26, 50, 200)), {f"ema_{n}": "d:" + ema(n, "close") for n in (12, 26, 50, 200)})

GAINS = (
    f"g AS (SELECT *, coalesce(greatest(close - {lag('close')}, 0), 0) AS gain,"
    f" coalesce(greatest({lag('close')} - close, 0), 0) AS loss FROM bars)"
)
AVG_GAINS = f"ag AS (SELECT *, {full(14, 'gain')} AS mg, {full(14, 'loss')} AS ml FROM g)"
RSI = f"CASE WHEN ml <> 0 THEN 100 - 100 / (1 + mg / ml) WHEN mg > 0 THEN 100.0 END"
register("d03_rsi", ind.rsi(14), {"rsi_14": "d:" + RSI}, [GAINS, AVG_GAINS])

MACD = [
    f"m1 AS (SELECT *, {ema(12, 'close')} - {ema(26, 'close')} AS macd FROM bars)",
    f"m2 AS (SELECT *, {ema(9, 'macd')} AS macd_signal FROM m1)",
]
register("d04_macd", ind.macd(),
         {"macd": "d:macd", "macd_signal": "d:macd_signal", "macd_hist": "d:macd - macd_signal"}, MACD)
register_minutes("d04_macd_minutes", ind.macd(),
                 {"macd": "d:macd", "macd_signal": "d:macd_signal", "macd_hist": "d:macd - macd_signal"}, MACD)

BB = [f"b AS (SELECT *, {full(20, 'close')} AS mid, {full(20, 'close', 'stddev_samp')} AS sd FROM bars)"]
BB_COLS = {
    "bb_middle_20": "d:mid", "bb_upper_20": "d:mid + 2 * sd", "bb_lower_20": "d:mid - 2 * sd",
    "bb_width_20": "d:4 * sd", "bb_position_20": "d:" + div("(close - (mid - 2 * sd))", "(mid + 2 * sd - (mid - 2 * sd))"),
}
register("d05_bollinger", ind.bollinger(20), BB_COLS, BB)

ATR = [TR, f"a AS (SELECT *, {full(14, 'tr')} AS atr FROM tr)"]
register("d06_atr", ind.atr(14), {"atr_14": "d:atr", "atr_percent_14": "d:100 * " + div("atr", "close")}, ATR)

STOCH = [
    f"s1 AS (SELECT *, {full(14, 'low', 'min')} AS lo, {full(14, 'high', 'max')} AS hi FROM bars)",
    f"s2 AS (SELECT *, 100 * {div('(close - lo)', '(hi - lo)')} AS k FROM s1)",
    f"s3 AS (SELECT *, {full(3, 'k')} AS d FROM s2)",
]
register("d07_stochastic", ind.stochastic(), {"stoch_k_14": "d:k", "stoch_d_3": "d:d"}, STOCH)

ADX = [
    TR,
    f"x1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - {lag('high')}, 0) END AS up,"
    f" CASE WHEN pc IS NOT NULL THEN greatest({lag('low')} - low, 0) END AS dn FROM tr)",
    f"x2 AS (SELECT *, 100 * {div(full(14, 'up'), full(14, 'tr'))} AS pdi,"
    f" 100 * {div(full(14, 'dn'), full(14, 'tr'))} AS mdi FROM x1)",
    f"x3 AS (SELECT *, 100 * {div('abs(pdi - mdi)', '(pdi + mdi)')} AS dx FROM x2)",
    f"x4 AS (SELECT *, {full(14, 'dx')} AS adx FROM x3)",
]
register("d08_adx_simple", ind.adx_simple(14), {"adx_14": "d:adx", "plus_di_14": "d:pdi", "minus_di_14": "d:mdi"}, ADX)

OBV = [
    f"o1 AS (SELECT *, coalesce(sign(close - {lag('close')}) * volume, 0) AS sv FROM bars)",
    f"o2 AS (SELECT *, CAST(sum(sv) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS obv FROM o1)",
    f"o3 AS (SELECT *, {ema(20, 'obv')} AS obv_ema FROM o2)",
]
register("d09_obv", ind.add_obv, {"obv": "d:obv", "obv_ema": "d:obv_ema"}, OBV)
register_minutes("d09_obv_minutes", ind.add_obv, {"obv": "d:obv", "obv_ema": "d:obv_ema"}, OBV)

CCI = [
    "c1 AS (SELECT *, (high + low + close) / 3 AS tp FROM bars)",
    f"c2 AS (SELECT *, {full(20, 'tp')} AS m, list(tp) OVER ({OVER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS win FROM c1)",
    f"c3 AS (SELECT *, {div('(tp - m)', '(0.015 * list_sum(list_transform(win, lambda x: abs(x - m))) / 20)')} AS cci FROM c2)",
]
register("d10_cci", ind.cci(20), {"cci_20": "d:cci"}, CCI)
register("d11_williams_r", ind.williams_r(14),
         {"williams_r_14": "d:-100 * " + div("(hi - close)", "(hi - lo)")}, STOCH[:1])
register("d12_returns", ind.returns(),
         {"returns": "d:returns", "log_returns": f"d:ln(nullif(close / nullif({lag('close')}, 0), 0))"}, [RET])
register("d13_lagged_returns", with_returns(ind.lagged_returns()),
         {f"returns_lag_{k}": "d:" + lag("returns", k) for k in (1, 2, 3, 5, 10)}, [RET])
register("d14_momentum", ind.momentum(), {f"momentum_{n}": "d:" + pct("close", lag("close", n)) for n in (5, 10, 20)})
SHAPE = {
    "hl_ratio": "d:" + div("(high - low)", "close"),
    "co_ratio": "d:" + div("(close - open)", "close"),
}
register("d15_bar_ratios", ind.bar_ratios(), SHAPE)
register("d16_gap", ind.gap(), {"gap": "d:" + pct("open", lag("close"))})
register("d17_volatility", with_returns(ind.volatility()),
         {f"volatility_{n}": f"d:{full(n, 'returns', 'stddev_samp')} * {S252}" for n in (10, 20, 50)}, [RET])
PARK = ["p AS (SELECT *, pow(ln(nullif(high / nullif(low, 0), 0)), 2) AS hl FROM bars)"]
register("d18_parkinson", ind.parkinson(),
         {f"parkinson_vol_{n}": f"d:sqrt({full(n, 'hl', 'sum')} / (4 * {n} * ln(2)))" for n in (10, 20)}, PARK)
VOV = [RET, f"v AS (SELECT *, {full(20, 'returns', 'stddev_samp')} * {S252} AS v20 FROM ret)"]
register("d19_vol_of_vol", with_returns(ind.volatility((20,)), ind.vol_of_vol()),
         {"vol_of_vol": "d:" + full(20, "v20", "stddev_samp")}, VOV)
VOLS = [f"v AS (SELECT *, {full(20, 'volume')} AS vs FROM bars)"]
register("d20_volume_ratio", ind.volume_features(), {"volume_sma_20": "d:vs", "volume_ratio": "d:" + div("volume", "vs")}, VOLS)
register("d21_volume_momentum", ind.volume_features(), {"volume_momentum": "d:" + pct("volume", lag("volume", 5))})
PVT = [RET, f"p AS (SELECT *, sum(returns * volume) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS pvt FROM ret)"]
register("d22_pvt", ind.add_pvt, {"pvt": "d:pvt"}, PVT, digits=3)

CLOCK = {
    "hour": "CAST(hour(ts) AS INTEGER)", "day_of_week": "CAST(isodow(ts) - 1 AS INTEGER)",
    "day_of_month": "CAST(day(ts) AS INTEGER)", "week_of_year": "CAST(week(ts) AS INTEGER)",
    "month": "CAST(month(ts) AS INTEGER)",
}
register("d23_time_parts", ind.time_features(), CLOCK)
CYCLES = {}
for _n, _e, _t in (("hour", "hour(ts)", 24), ("day", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)):
    for _f in ("sin", "cos"):
        CYCLES[f"{_n}_{_f}"] = f"d:{_f}({_e} * 2 * pi() / {_t})"
register("d24_time_cycles", ind.time_features(), CYCLES)
register("d25_sessions", ind.time_features(),
         {f"{n}_session": flag(f"hour(ts) >= {lo} AND hour(ts) < {lo + 8}") for n, lo in (("asian", 0), ("european", 8), ("us", 16))})
register("d26_doji", ind.candle_shapes(), {"doji": flag(div("abs(close - open)", "(high - low)") + " < 0.1")})
register("d27_hammer", ind.candle_shapes(),
         {"hammer": flag("least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < abs(close - open)")})
PREV = [f"p AS (SELECT *, {lag('open')} AS po, {lag('close')} AS pk FROM bars)"]
ENGULF = {
    "bullish_engulfing": flag("close > open AND po > pk AND close > po AND open < pk"),
    "bearish_engulfing": flag("open > close AND pk > po AND open > pk AND close < po"),
}
register("d28_engulfing", ind.engulfing(), ENGULF, PREV)
register("d29_roc", with_returns(ind.momentum_features()),
         {f"roc_{n}": "d:" + pct("close", lag("close", n)) for n in (5, 10, 20)})
ACCEL = {"momentum_oscillator": f"d:close - {lag('close', 10)}", "price_acceleration": f"d:returns - {lag('returns')}"}
register("d30_acceleration", with_returns(ind.momentum_features()), ACCEL, [RET])
TREND = [
    "t AS (SELECT *, " + ", ".join(f"{full(n, 'close')} AS s{n}" for n in (20, 50, 200))
    + f", {ema(12, 'close')} AS e12, {ema(26, 'close')} AS e26 FROM bars)"
]
register("d31_trend_strength", ind.chain(ind.beside(ind.sma(), ind.ema()), ind.trend_fallback()),
         {"trend_strength": "d:" + div("abs(e12 - e26)", "close")}, TREND)
register("d32_price_vs_sma", ind.chain(ind.beside(ind.sma(), ind.ema()), ind.trend_fallback()),
         {**{f"price_vs_sma_{n}": "d:" + pct("close", f"s{n}") for n in (20, 50, 200)},
          **{f"sma_{n}_slope": "d:" + div(f"(s{n} - {lag(f's{n}', 5)})", f"s{n}") for n in (20, 50)}}, TREND)
RANK = [
    *VOV,
    f"w AS (SELECT *, list(v20) OVER ({OVER} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS raw FROM v)",
    "w2 AS (SELECT *, list_filter(raw, lambda x: x IS NOT NULL) AS win FROM w)",
    "w3 AS (SELECT *, CASE WHEN len(win) = 100 THEN (len(list_filter(win, lambda x: x < v20))"
    " + (len(list_filter(win, lambda x: x = v20)) + 1) / 2.0) / 100.0 END AS vp FROM w2)",
]
register("d33_vol_percentile", with_returns(ind.volatility((20,)), ind.vol_percentile()),
         {"vol_percentile": "d:CAST(vp AS DOUBLE)", "high_vol_regime": flag("vp > 0.7"), "low_vol_regime": flag("vp < 0.3")}, RANK)
INDEX = [
    RET,
    f"i1 AS (SELECT *, {full(20, 'returns', 'stddev_samp')} AS vr, {full(10, 'returns', 'stddev_samp')} * {S252} * 100 AS vix FROM ret)",
    f"i2 AS (SELECT *, {full(60, 'vr')} AS m60 FROM i1)",
]
INDEX_IND = with_returns(ind.index_specific())
register("d35_index_volatility", INDEX_IND, {"volatility_regime": "d:vr", "high_vol": flag("vr > m60")}, INDEX)
register("d36_fear_level", INDEX_IND,
         {"vix_proxy": "d:vix", "fear_level": "CASE WHEN vix > 35 THEN 2 WHEN vix > 25 THEN 1 ELSE 0 END"}, INDEX)
LEFT = "date_diff('day', CAST(ts AS DATE), last_day(ts))"
register("d37_calendar_flags", INDEX_IND,
         {"fed_hawkish": flag("CAST(ts AS DATE) >= DATE '2022-01-01'"), "days_to_month_end": f"CAST({LEFT} AS INTEGER)",
          "month_end_period": flag(f"{LEFT} <= 3")})
M8020 = [
    TR.replace("greatest(", f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(", 1).replace(") AS tr,", ") END AS tr,", 1),
    f"m AS (SELECT *, {full(10, 'close')} AS ss, {full(20, 'close')} AS sl, 100 * {pct('close', lag('close', 10))} AS roc,"
    f" {full(14, 'tr')} AS atr FROM tr)",
]
register("d38_momentum_80_20", ind.momentum_80_20(),
         {"sma_short": "d:ss", "sma_long": "d:sl", "roc": "d:roc", "tr": "d:tr", "atr": "d:atr",
          "trend_strength": "d:100 * " + pct("ss", "sl")}, M8020)
CHANNEL = [f"c1 AS (SELECT *, {full(20, 'high', 'max')} AS hi, {full(20, 'low', 'min')} AS lo FROM bars)"]
register("d39_price_channel", ind.price_channel(20),
         {"channel_high_20": "d:" + lag("hi"), "channel_low_20": "d:" + lag("lo")}, CHANNEL)


# one chain of stages that adds every feature, for the complete set
WIDE = [
    f"f1 AS (SELECT *, {pct('close', lag('close'))} AS returns, {lag('close')} AS pc, (high + low + close) / 3 AS tp,"
    f" greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,"
    f" coalesce(greatest(close - {lag('close')}, 0), 0) AS gain, coalesce(greatest({lag('close')} - close, 0), 0) AS loss,"
    f" CASE WHEN {lag('high')} IS NOT NULL THEN greatest(high - {lag('high')}, 0) END AS up,"
    f" CASE WHEN {lag('low')} IS NOT NULL THEN greatest({lag('low')} - low, 0) END AS dn,"
    f" coalesce(sign(close - {lag('close')}) * volume, 0) AS sv,"
    f" pow(ln(nullif(high / nullif(low, 0), 0)), 2) AS hl, {lag('open')} AS po FROM bars)",
    "f2 AS (SELECT *, " + ", ".join(f"{full(n, 'close')} AS sma_{n}" for n in (10, 20, 50, 200)) + ", "
    + ", ".join(f"{ema(n, 'close')} AS ema_{n}" for n in (12, 26, 50)) + ", "
    + ", ".join(f"{full(n, 'returns', 'stddev_samp')} * {S252} AS volatility_{n}" for n in (10, 20, 50))
    + f", {full(14, 'gain')} AS mg, {full(14, 'loss')} AS ml, {full(20, 'close', 'stddev_samp')} AS sd,"
    f" {full(14, 'tr')} AS atr, {full(14, 'low', 'min')} AS lo, {full(14, 'high', 'max')} AS hi,"
    f" 100 * {div(full(14, 'up'), full(14, 'tr'))} AS pdi, 100 * {div(full(14, 'dn'), full(14, 'tr'))} AS mdi,"
    f" {full(20, 'tp')} AS mtp, list(tp) OVER ({OVER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS win,"
    f" CAST(sum(sv) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS obv,"
    f" sum(returns * volume) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS pvt, {full(20, 'volume')} AS vs,"
    f" {full(20, 'returns', 'stddev_samp')} AS v20d, {full(200, 'returns', 'stddev_samp')} AS v200d FROM f1)",
    f"f3 AS (SELECT *, ema_12 - ema_26 AS macd, 100 * {div('(close - lo)', '(hi - lo)')} AS k,"
    f" 100 * {div('abs(pdi - mdi)', '(pdi + mdi)')} AS dx, {ema(20, 'obv')} AS obv_ema,"
    f" {flag('close > sma_200')} AS above, {pct('sma_200', lag('sma_200', 50))} AS slope,"
    f" {pct('close', 'sma_200')} AS pvm, {div('v20d', 'v200d')} AS vr FROM f2)",
    f"f4 AS (SELECT *, {ema(9, 'macd')} AS macd_signal, {full(50, 'above')} AS strength FROM f3)",
]
WIDE_COLS = {
    "returns": "d:returns", "log_returns": "d:ln(nullif(close / nullif(pc, 0), 0))",
    **{f"returns_lag_{k}": "d:" + lag("returns", k) for k in (1, 2, 3, 5, 10)},
    **{f"momentum_{n}": "d:" + pct("close", lag("close", n)) for n in (5, 10, 20)},
    **SHAPE, "gap": "d:" + pct("open", "pc"),
    **{f"sma_{n}": f"d:sma_{n}" for n in (10, 20, 50, 200)}, **{f"ema_{n}": f"d:ema_{n}" for n in (12, 26, 50)},
    "rsi_14": "d:" + RSI, "macd": "d:macd", "macd_signal": "d:macd_signal", "macd_hist": "d:macd - macd_signal",
    **{k: v.replace("mid", "sma_20") for k, v in BB_COLS.items()},
    "atr_14": "d:atr", "atr_percent_14": "d:100 * " + div("atr", "close"),
    "stoch_k_14": "d:k", "stoch_d_3": "d:" + full(3, "k"), "adx_14": "d:" + full(14, "dx"), "plus_di_14": "d:pdi",
    "minus_di_14": "d:mdi",
    "cci_20": "d:" + div("(tp - mtp)", "(0.015 * list_sum(list_transform(win, lambda x: abs(x - mtp))) / 20)"),
    "williams_r_14": "d:-100 * " + div("(hi - close)", "(hi - lo)"),
    "obv": "d:obv", "obv_ema": "d:obv_ema", "volume_sma_20": "d:vs", "volume_ratio": "d:" + div("volume", "vs"),
    "volume_momentum": "d:" + pct("volume", lag("volume", 5)), "pvt": "d3:pvt",
    **{f"volatility_{n}": f"d:volatility_{n}" for n in (10, 20, 50)},
    **{f"parkinson_vol_{n}": f"d:sqrt({full(n, 'hl', 'sum')} / (4 * {n} * ln(2)))" for n in (10, 20)},
    "vol_of_vol": "d:" + full(20, "volatility_20", "stddev_samp"),
    **CLOCK, **CYCLES,
    **{f"{n}_session": flag(f"hour(ts) >= {lo} AND hour(ts) < {lo + 8}") for n, lo in (("asian", 0), ("european", 8), ("us", 16))},
    "doji": flag(div("abs(close - open)", "(high - low)") + " < 0.1"),
    "hammer": flag("least(open, close) - low > 2 * abs(close - open) AND high - greatest(open, close) < abs(close - open)"),
    **{k: v.replace("pk", "pc") for k, v in ENGULF.items()},
    **{f"roc_{n}": "d:" + pct("close", lag("close", n)) for n in (5, 10, 20)},
    **ACCEL,
    "ma_200": "d:sma_200", "price_vs_ma_200": "d:pvm", "above_ma_200": "above", "ma_200_slope": "d:slope",
    "trend_strength": "d:strength", "volatility_20d": "d:v20d", "volatility_200d": "d:v200d", "volatility_regime": "d:vr",
    "regime": "CASE WHEN vr > 1.5 THEN 3 WHEN pvm < -0.02 AND slope < -0.01 AND strength < 0.4 THEN 0"
    " WHEN pvm > 0.02 AND slope > 0.01 AND strength > 0.6 THEN 2 ELSE 1 END",
}


@query("d34_feature_set", pick([BARS, *WIDE], "f4", KEYS, WIDE_COLS))
def complete(spark, sf_dir):
    return rounded(ind.feature_set(event_bars(spark, sf_dir)).select(*KEYS, *ind.feature_columns()), pvt=3)


@query("d40_crossovers", stages(BARS, *M8020,
       f"p AS (SELECT *, {lag('ss')} AS pss, {lag('sl')} AS psl FROM m)") + f"""
SELECT symbol, count(*) FILTER (WHERE pss <= psl AND ss > sl) AS bullish_crossovers,
       count(*) FILTER (WHERE pss >= psl AND ss < sl) AS bearish_crossovers,
       round(avg({flag('ss > sl')}), 6) AS share_short_above_long,
       round(avg({flag('roc > 0.5')}), 6) AS share_positive_roc,
       round(avg({flag('roc > 0.5 AND ss > sl')}), 6) AS share_buy_condition
FROM p GROUP BY symbol""")
def crossovers(spark, sf_dir):
    return rounded(ind.crossover_counts(event_bars(spark, sf_dir)))


@query("d41_buy_and_hold", stages(BARS) + """
SELECT symbol, round((arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts), 6) AS buy_hold_return
FROM bars GROUP BY symbol""")
def hold(spark, sf_dir):
    return rounded(ind.buy_and_hold(event_bars(spark, sf_dir)))
