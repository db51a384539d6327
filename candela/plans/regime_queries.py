"""Target and regime queries on hourly bars per event type."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from candela.operators import indicators as ind
from candela.operators import regimes as reg
from candela.operators import walkforward as wf
from candela.plans.registry import query
from candela.plans.sqltext import BARS, OVER, div, flag, full, lag, lead, pct, pick, r, rounded, stages
from candela.sources.driver_tables import event_bars

KEYS = ["symbol", "ts"]
S252 = repr(math.sqrt(252))
FUT = f"fut AS (SELECT *, {pct(lead('close', 5), 'close')} AS fr FROM bars)"


def on_bars(name, fn, cols, ctes=(), digits=6):
    ctes = [BARS, *ctes]

    @query(name, pick(ctes, ctes[-1].split(" AS ")[0], KEYS, cols, digits))
    def run(spark, sf_dir):
        return rounded(fn(event_bars(spark, sf_dir)).select(*KEYS, *cols), digits)


on_bars("e01_targets", reg.add_targets, {
    "future_return": "d:fr",
    "target_class": "CASE WHEN fr > 0.001 THEN 1 WHEN fr < -0.001 THEN -1 WHEN fr IS NOT NULL THEN 0 END",
    "target_binary": "CASE WHEN fr > 0 THEN 1 WHEN fr IS NOT NULL THEN 0 END",
    "target_regression": "d:fr",
}, [FUT])
on_bars("e01_targets_tail_zero", lambda b: reg.add_targets(b, tail="zero"), {
    "future_return": "d:fr",
    "target_class": "CASE WHEN fr > 0.001 THEN 1 WHEN fr < -0.001 THEN -1 ELSE 0 END",
    "target_binary": "CASE WHEN fr > 0 THEN 1 ELSE 0 END",
}, [FUT])
on_bars("e02_next_bar_target", reg.add_binary_target,
        {"target": f"CASE WHEN {lead('close')} > close THEN 1 WHEN {lead('close')} IS NOT NULL THEN 0 END"})
on_bars("e03_target", lambda b: reg.add_binary_target(b, 3, 0.02),
        {"target": f"CASE WHEN {pct(lead('close', 3), 'close')} > 0.02 THEN 1 WHEN {lead('close', 3)} IS NOT NULL THEN 0 END"})


@query("e04_label_distribution", stages(BARS, FUT) + f"""
SELECT symbol, count(*) FILTER (WHERE fr <= 0) AS sell_hold, count(*) FILTER (WHERE fr > 0) AS buy,
  count(*) AS labelled, {r("100.0 * count(*) FILTER (WHERE fr <= 0) / count(*)")} AS sell_hold_pct,
  {r("100.0 * count(*) FILTER (WHERE fr > 0) / count(*)")} AS buy_pct,
  {r("coalesce(count(*) FILTER (WHERE fr <= 0) / nullif(count(*) FILTER (WHERE fr > 0), 0), 0)")} AS imbalance_ratio
FROM fut WHERE fr IS NOT NULL GROUP BY symbol""")
def labels(spark, sf_dir):
    return rounded(reg.label_distribution(event_bars(spark, sf_dir)))


on_bars("e05_horizon_targets", reg.add_horizon_targets, {
    f"target_{h}": f"CASE WHEN {lead('close', h)} > close THEN 1 WHEN {lead('close', h)} IS NOT NULL THEN 0 END"
    for h in (1, 3, 5, 10)
})

RET = f"ret AS (SELECT *, {pct('close', lag('close'))} AS returns FROM bars)"
V1 = [
    RET,
    f"r1 AS (SELECT *, {full(200, 'close')} AS ma, {full(20, 'returns', 'stddev_samp')} AS v20,"
    f" {full(200, 'returns', 'stddev_samp')} AS v200 FROM ret)",
    f"r2 AS (SELECT *, {pct('close', 'ma')} AS pvm, {flag('close > ma')} AS above, {pct('ma', lag('ma', 50))} AS slope,"
    f" {pct('ma', lag('ma', 49))} AS slope49, {div('v20', 'v200')} AS vr,"
    f" avg(v200) OVER ({OVER} ROWS UNBOUNDED PRECEDING) AS avg200, row_number() OVER ({OVER}) AS rn FROM r1)",
    f"r3 AS (SELECT *, {full(50, 'above')} AS strength FROM r2)",
]


def rule(slope, stormy, strength="strength"):
    return (
        f"CASE WHEN {stormy} THEN 3 WHEN pvm < -0.02 AND {slope} < -0.01 AND {strength} < 0.4 THEN 0"
        f" WHEN pvm > 0.02 AND {slope} > 0.01 AND {strength} > 0.6 THEN 2 ELSE 1 END"
    )


V1_CLASS = rule("slope", "vr > 1.5")
AS_OF = f"CASE WHEN rn < 200 THEN 1 ELSE {rule('slope49', 'v20 > avg200 * 1.5')} END"
V1_COLS = {
    "ma_200": "d:ma", "price_vs_ma_200": "d:pvm", "above_ma_200": "above", "ma_200_slope": "d:slope",
    "trend_strength": "d:strength", "volatility_20d": "d:v20", "volatility_200d": "d:v200", "volatility_regime": "d:vr",
}
on_bars("e06_regime_features", reg.regime_features(), V1_COLS, V1)
on_bars("e07_regime_class", reg.regime_features(), {"regime": V1_CLASS}, V1)
on_bars("e08_regime_as_of", reg.regime_as_of, {
    "price_vs_ma": "d:pvm", "ma_slope": "d:slope49", "volatility": "d:v20", "avg_volatility": "d:avg200",
    "regime": AS_OF,
}, V1)
PARAMS = (
    "params(regime_name, regime, confidence_threshold, position_size_pct, stop_loss_atr_mult, take_profit_atr_mult,"
    " max_daily_loss_pct) AS (VALUES ('bear', 0, 0.65::DOUBLE, 0.015::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE, 0.02::DOUBLE),"
    " ('sideways', 1, 0.55, 0.02, 2.0, 3.0, 0.03), ('bull', 2, 0.50, 0.025, 2.5, 4.0, 0.04),"
    " ('volatile', 3, 0.70, 0.01, 3.0, 2.5, 0.015))"
)
PARAM_COLS = (
    "regime_name, confidence_threshold, position_size_pct, stop_loss_atr_mult, take_profit_atr_mult, max_daily_loss_pct"
)


@query("e09_regime_parameters", stages(BARS, *V1, PARAMS, f"cls AS (SELECT symbol, ts, {V1_CLASS} AS regime FROM r3)")
       + f"SELECT symbol, ts, regime, {PARAM_COLS} FROM cls JOIN params USING (regime)")
def parameters(spark, sf_dir):
    df = reg.with_regime_parameters(reg.regime_features()(event_bars(spark, sf_dir)))
    return df.select(*KEYS, "regime", *PARAM_COLS.split(", "))


@query("e10_regime_statistics", stages(
    BARS, *V1, f"cls AS (SELECT symbol, ts, close, {V1_CLASS} AS regime FROM r3)",
    f"st AS (SELECT *, {pct('close', lag('close', 1, 'PARTITION BY symbol, regime ORDER BY ts'))} AS rr FROM cls)") + f"""
SELECT symbol, regime, count(*) AS days, {r("100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol)")} AS pct_of_total,
  {r("avg(rr) * 100")} AS avg_return, {r("stddev_samp(rr) * 100")} AS volatility,
  {r(f"CASE WHEN stddev_samp(rr) > 0 THEN avg(rr) / stddev_samp(rr) * {S252} ELSE 0 END")} AS sharpe,
  {r("max(rr) * 100")} AS max_gain, {r("min(rr) * 100")} AS max_loss
FROM st GROUP BY symbol, regime""")
def statistics(spark, sf_dir):
    return rounded(reg.regime_statistics(reg.regime_features()(event_bars(spark, sf_dir))))


@query("e11_current_regime", stages(BARS, *V1, PARAMS, f"cls AS (SELECT symbol, ts, rn, {AS_OF} AS regime FROM r3)",
       "lst AS (SELECT symbol, max(ts) AS ts FROM bars GROUP BY symbol)")
       + f"SELECT symbol, ts, regime, {PARAM_COLS} FROM cls JOIN lst USING (symbol, ts) JOIN params USING (regime)")
def current(spark, sf_dir):
    return reg.current_regime(event_bars(spark, sf_dir)).select(*KEYS, "regime", *PARAM_COLS.split(", "))


V2_FEATURES = ind.beside(ind.atr(14), ind.sma((50, 200)), ind.chain(ind.returns(), ind.momentum_features((20,))))
V2 = [
    f"t1 AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars)",
    f"t2 AS (SELECT *, 100 * {div(full(14, 'tr'), 'close')} AS v, {full(50, 'close')} AS a, {full(200, 'close')} AS b,"
    f" 100 * {pct('close', lag('close', 20))} AS m, row_number() OVER ({OVER}) AS rn FROM t1)",
    "t3 AS (SELECT *, CASE WHEN close > a AND a > b THEN 1 WHEN close < a AND a < b THEN -1 ELSE 0 END AS d,"
    f" 100 * {div('abs(a - b)', 'b')} AS t FROM t2)",
    "t4 AS (SELECT *, v IS NOT NULL AND t IS NOT NULL AS known, coalesce(v > 3, false) AS stormy,"
    " coalesce((d = -1 AND t > 3) OR (m < -10 AND v > 2), false) AS bearish, coalesce(d = 1 AND t > 3, false) AS rising FROM t3)",
    "t5 AS (SELECT *, CASE WHEN NOT known THEN 'UNKNOWN' WHEN stormy THEN 'VOLATILE' WHEN bearish THEN 'BEAR'"
    " WHEN rising THEN 'BULL' ELSE 'SIDEWAYS' END AS regime_name FROM t4)",
]


def range_regime(bars):
    return reg.classify_range_regime(reg.regime_inputs(V2_FEATURES(bars)))


on_bars("e12_range_regime_inputs", lambda b: reg.regime_inputs(V2_FEATURES(b)),
        {"volatility": "d:v", "trend_direction": "d", "trend_strength": "d:t", "momentum": "d:m"}, V2[:3])
X = f"(row_number() OVER ({OVER}))::DOUBLE"
FALL = [
    f"x0 AS (SELECT *, {X} AS x, {pct('close', lag('close'))} AS rt FROM bars)",
    "x1 AS (SELECT *, CASE WHEN x >= 50 THEN regr_slope(close, x) OVER (" + OVER
    + f" ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS s, {full(50, 'close')} AS mean,"
    f" {full(49, 'rt', 'stddev_samp')} * {S252} * 100 AS v FROM x0)",
]
on_bars("e12_range_regime_fallback", reg.regime_inputs_fallback(),
        {"volatility": "d:v", "trend_direction": "CASE WHEN s > 0 THEN 1 WHEN s < 0 THEN -1 ELSE 0 END",
         "trend_strength": "d:" + div("abs(s)", "mean") + " * 100 * 50",
         "momentum": "d:100 * " + pct("close", lag("close", 19))}, FALL, digits=4)
on_bars("e13_range_regime_class", range_regime, {
    "regime_name": "regime_name",
    "regime_confidence": "d:CAST(CASE WHEN NOT known THEN 0 WHEN stormy THEN least(v / 3, 2) WHEN bearish THEN greatest("
    "CASE WHEN d = -1 THEN least(t / 3, 2) ELSE 0 END, CASE WHEN m < -10 THEN least(abs(m) / 10, 2) ELSE 0 END)"
    " WHEN rising THEN least(t / 3, 2) ELSE 1 END AS DOUBLE)",
}, V2)
SETTINGS = (
    "settings(regime_name, adj, position_multiplier, use_balanced) AS (VALUES ('BULL', -0.10::DOUBLE, 1.0::DOUBLE, true),"
    " ('BEAR', 0.15, 0.5, false), ('VOLATILE', 0.20, 0.3, false), ('SIDEWAYS', 0.05, 0.7, true), ('UNKNOWN', 0.10, 0.5, true))"
)


@query("e14_adaptive_settings", stages(BARS, *V2, SETTINGS) + f"""
SELECT symbol, ts, regime_name, {r("greatest(0.5, least(0.9, 0.6 + adj))")} AS confidence_threshold, position_multiplier,
  regime_name = 'VOLATILE' AS skip_trading FROM t5 JOIN settings USING (regime_name)""")
def adaptive(spark, sf_dir):
    df = reg.with_adaptive_settings(range_regime(event_bars(spark, sf_dir)), 0.6, skip_volatile=True)
    return rounded(df.select(*KEYS, "regime_name", "confidence_threshold", "position_multiplier", "skip_trading"))


@query("e15_ensemble_settings", stages(BARS, *V2, SETTINGS) + f"""
SELECT symbol, ts, regime_name, {r("greatest(0.5, least(0.9, 0.6 + adj))")} AS confidence_threshold, position_multiplier,
  use_balanced FROM t5 JOIN settings USING (regime_name)""")
def ensemble(spark, sf_dir):
    df = reg.with_adaptive_settings(range_regime(event_bars(spark, sf_dir)), 0.6)
    return rounded(df.select(*KEYS, "regime_name", "confidence_threshold", "position_multiplier", "use_balanced"))


FLAG_FEATURES = ind.beside(
    ind.adx_simple(14), ind.sma((50, 200)), ind.rsi(14), ind.chain(ind.returns(), ind.volatility((20,)))
)
FLAGS = [
    f"f1 AS (SELECT *, {pct('close', lag('close'))} AS rt, coalesce(greatest(close - {lag('close')}, 0), 0) AS gain,"
    f" coalesce(greatest({lag('close')} - close, 0), 0) AS loss,"
    f" greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr,"
    f" CASE WHEN {lag('high')} IS NOT NULL THEN greatest(high - {lag('high')}, 0) END AS up,"
    f" CASE WHEN {lag('low')} IS NOT NULL THEN greatest({lag('low')} - low, 0) END AS dn FROM bars)",
    f"f2 AS (SELECT *, 100 * {div(full(14, 'up'), full(14, 'tr'))} AS p, 100 * {div(full(14, 'dn'), full(14, 'tr'))} AS q,"
    f" {full(14, 'gain')} AS mg, {full(14, 'loss')} AS ml, {full(20, 'rt', 'stddev_samp')} * {S252} AS vol,"
    f" {full(50, 'close')} AS a, {full(200, 'close')} AS b, {full(20, 'close', 'max')} AS hi, {full(20, 'close', 'min')} AS lo FROM f1)",
    f"f3 AS (SELECT *, 100 * {div('abs(p - q)', '(p + q)')} AS dx, {full(100, 'vol', 'median', 20)} AS med,"
    f" a - {lag('a', 5)} AS step, {lag('hi', 20)} AS phi, {lag('lo', 20)} AS plo,"
    " CASE WHEN ml <> 0 THEN 100 - 100 / (1 + mg / ml) WHEN mg > 0 THEN 100 END AS rsi FROM f2)",
    f"f4 AS (SELECT *, {full(14, 'dx')} AS adx FROM f3)",
]
on_bars("e16_regime_flags", ind.chain(FLAG_FEATURES, reg.regime_flags()), {
    "regime_trending": flag("adx > 25"), "regime_ranging": flag("adx < 20"),
    "regime_bull": flag("close > a AND a > b AND step > 0"), "regime_bear": flag("close < a AND a < b AND step < 0"),
    "regime_high_vol": flag("vol > med * 1.5"), "regime_low_vol": flag("vol < med * 0.7"),
    "regime_overbought": flag("rsi > 70"), "regime_oversold": flag("rsi < 30"),
    "regime_uptrend": flag("hi > phi"), "regime_downtrend": flag("lo < plo"),
}, FLAGS)


@query("e17_regime_distribution", stages(BARS, *V1, f"cls AS (SELECT symbol, {V1_CLASS} AS regime FROM r3)") + f"""
SELECT symbol, regime, count(*) AS n, {r("100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol)")} AS pct
FROM cls GROUP BY symbol, regime""")
def spread_of_regimes(spark, sf_dir):
    return rounded(reg.distribution(reg.regime_features()(event_bars(spark, sf_dir)), "regime"))


@query("e18_dominant_regime", stages(
    BARS, *V2,
    "n AS (SELECT symbol, max(rn) AS n FROM t5 GROUP BY symbol)",
    "sp AS (SELECT symbol, i + 1 AS split_num, i * 50 + 41 AS a, i * 50 + 50 AS b FROM n, unnest(range(n // 50)) u(i))",
    "pt AS (SELECT symbol, split_num, unnest([0, 1, 2]) AS p, unnest([a, a + 5, b]) AS rn FROM sp)",
    "vt AS (SELECT symbol, split_num, regime_name, count(*) AS c, min(p) AS p FROM pt JOIN t5 USING (symbol, rn) GROUP BY ALL)")
    + "SELECT symbol, split_num, arg_max(regime_name, c * 10 - p) AS dominant_regime FROM vt GROUP BY symbol, split_num")
def dominant(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    numbered = wf.number_rows(range_regime(bars))
    splits = wf.row_splits(wf.series_lengths(bars), 40, 10, 50)
    return reg.dominant_regime(numbered, splits)
