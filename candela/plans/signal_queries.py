"""Signal queries on hourly bars per event type."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import indicators as ind
from candela.operators import regimes as reg
from candela.operators import signals as sig
from candela.operators import walkforward as wf
from candela.plans.fitted_scores import HORIZON_SCORES, score_sql, scored_bars
from candela.plans.regime_queries import AS_OF, PARAMS, SETTINGS, V1, V2, range_regime
from candela.plans.registry import query
from candela.plans.sqltext import BARS, OVER, flag, full, lag, pct, pick, r, rounded, stages
from candela.sources.driver_tables import event_bars

KEYS = ["symbol", "ts"]


def base(name="z0"):
    """SQL stage with everything the price rules read."""
    return [
        f"z0 AS (SELECT *, row_number() OVER ({OVER}) AS rn, coalesce(greatest(close - {lag('close')}, 0), 0) AS gain,"
        f" coalesce(greatest({lag('close')} - close, 0), 0) AS loss, {pct('close', lag('close'))} AS rt,"
        f" greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars)",
        "z1 AS (SELECT *, " + ", ".join(f"{full(n, 'close')} AS s{n}" for n in (10, 20, 30, 50, 70))
        + f", {full(14, 'gain')} AS mg, {full(14, 'loss')} AS ml, {full(14, 'close', 'stddev_samp')} AS sd,"
        f" {full(20, 'close', 'stddev_samp')} AS bsd, {full(20, 'high', 'max')} AS chi, {full(20, 'low', 'min')} AS clo,"
        f" {full(14, 'tr')} AS atr, {full(20, 'rt', 'stddev_samp')} AS dev FROM z0)",
        "z2 AS (SELECT *, CASE WHEN ml <> 0 THEN 100 - 100 / (1 + mg / ml) WHEN mg > 0 THEN 100 END AS rsi, "
        + ", ".join(f"{lag(f's{n}')} AS p{n}" for n in (10, 20, 30, 50, 70))
        + f", {lag('chi')} AS ph, {lag('clo')} AS pl FROM z1)",
    ]


def cross(a, b, min_rows):
    buy = f"coalesce(rn >= {min_rows} AND p{a} <= p{b} AND s{a} > s{b} AND rsi < 70, false)"
    sell = f"coalesce(rn >= {min_rows} AND p{a} >= p{b} AND s{a} < s{b} AND rsi > 30, false)"
    return buy, sell


def outcome(buy, sell, stop, target, names, fixed=None, prefix=""):
    up, down = (fixed, fixed) if fixed else (f"close + {target}", f"close - {target}")
    return (
        f"CASE WHEN {buy} THEN 'buy' WHEN {sell} THEN 'sell' END AS {prefix}action,"
        f" CASE WHEN {buy} THEN close - {stop} WHEN {sell} THEN close + {stop} END AS {prefix}stop_loss,"
        f" CASE WHEN {buy} THEN {up} WHEN {sell} THEN {down} END AS {prefix}take_profit,"
        f" CASE WHEN {buy} THEN {names[0]} WHEN {sell} THEN {names[1]} END AS {prefix}reason"
    )


CROSS_NAMES = ("'bullish_crossover'", "'bearish_crossover'")
MOM = outcome(*cross(20, 50, 51), "2 * sd", "3 * sd", CROSS_NAMES)
FAST = outcome(*cross(10, 30, 31), "2 * sd", "3 * sd", CROSS_NAMES)
REV = outcome("coalesce(rn >= 21 AND close <= s20 - 2 * bsd AND rsi < 30, false)",
              "coalesce(rn >= 21 AND close >= s20 + 2 * bsd AND rsi > 70, false)", "1.5 * sd", "",
              ("'oversold_mean_reversion'", "'overbought_mean_reversion'"), fixed="s20")
BRK = outcome("coalesce(rn >= 21 AND close > ph, false)", "coalesce(rn >= 21 AND close < pl, false)", "2 * atr", "3 * atr",
              ("'bullish_breakout'", "'bearish_breakout'"))
ENTRY_COLS = {"action": "action", "stop_loss": "d:stop_loss", "take_profit": "d:take_profit", "reason": "reason"}


def on_rule(name, rule, sql, ctes=None, entries_only=True, extra=None):
    ctes = ctes or [BARS, *base(), f"sg AS (SELECT *, {sql} FROM z2)"]
    cols = {**ENTRY_COLS, **(extra or {})} if entries_only else extra

    @query(name, pick(ctes, "sg", KEYS, cols, where="action IN ('buy', 'sell')" if entries_only else ""))
    def run(spark, sf_dir):
        out = rule(event_bars(spark, sf_dir))
        return rounded((sig.entries(out) if entries_only else out).select(*KEYS, *cols))


on_rule("f01_momentum", sig.momentum_rule(), MOM)
on_rule("f01_momentum_fast", sig.momentum_rule(10, 30), FAST)
on_rule("f02_momentum_exits", sig.momentum_rule(), MOM, entries_only=False,
        extra={"exit_long": flag("rn >= 51 AND s20 < s50"), "exit_short": flag("rn >= 51 AND s20 > s50")})
on_rule("f03_mean_reversion", sig.mean_reversion_rule(), REV)
on_rule("f04_mean_reversion_exits", sig.mean_reversion_rule(), REV, entries_only=False,
        extra={"exit_long": flag("rn >= 21 AND close >= s20"), "exit_short": flag("rn >= 21 AND close <= s20")})
on_rule("f05_breakout", sig.breakout_rule(), BRK)
VOTERS = [sig.momentum_rule(), sig.mean_reversion_rule(), sig.breakout_rule()]
PAIR = [sig.momentum_rule(10, 30), sig.breakout_rule()]


def votes(sources, names, threshold):
    lead = [f"{n}_t AS (SELECT *, {sql} FROM z2)" for n, sql in zip(names, sources)]
    union = " UNION ALL ".join(f"SELECT symbol, ts, action, stop_loss, take_profit FROM {n}_t" for n in names)
    total = len(names)
    return [
        *base(), *lead, f"al AS ({union})",
        "ct AS (SELECT symbol, ts, count(*) FILTER (WHERE action = 'buy') AS b, count(*) FILTER (WHERE action = 'sell') AS s,"
        " avg(stop_loss) FILTER (WHERE action = 'buy') AS bs, avg(take_profit) FILTER (WHERE action = 'buy') AS bt,"
        " avg(stop_loss) FILTER (WHERE action = 'sell') AS ss, avg(take_profit) FILTER (WHERE action = 'sell') AS st"
        " FROM al GROUP BY symbol, ts)",
        f"sg AS (SELECT symbol, ts, CASE WHEN b {threshold} THEN 'buy' WHEN s {threshold} THEN 'sell' END AS action,"
        f" CASE WHEN b {threshold} THEN bs WHEN s {threshold} THEN ss END AS stop_loss,"
        f" CASE WHEN b {threshold} THEN bt WHEN s {threshold} THEN st END AS take_profit,"
        f" CASE WHEN b {threshold} THEN 'ensemble_buy_' || b || '/{total}'"
        f" WHEN s {threshold} THEN 'ensemble_sell_' || s || '/{total}' END AS reason FROM ct)",
    ]


on_rule("f08_vote_majority", sig.vote_rule(VOTERS), "", [BARS, *votes([MOM, REV, BRK], ["m", "v", "k"], "> 1.5")])
UNANIMOUS = votes([FAST, BRK], ["m", "k"], "= 2")
UNANIMOUS[-1] = UNANIMOUS[-1].replace("'ensemble_buy_' || b || '/2'", "'ensemble_unanimous_buy'").replace(
    "'ensemble_sell_' || s || '/2'", "'ensemble_unanimous_sell'")
on_rule("f08_vote_unanimous", sig.vote_rule(PAIR, "unanimous"), "", [BARS, *UNANIMOUS])

WB, WS = cross(10, 30, 100)
CB, CS = cross(30, 70, 100)
WILD = "coalesce(dev > 0.002, false)"
on_rule("f09_adaptive_momentum", sig.adaptive_momentum_rule(),
        outcome(f"(CASE WHEN {WILD} THEN {WB} ELSE {CB} END)", f"(CASE WHEN {WILD} THEN {WS} ELSE {CS} END)",
                "2 * sd", "3 * sd", CROSS_NAMES))

TR80 = f"CASE WHEN {lag('close')} IS NOT NULL THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"
M80 = [
    f"m1 AS (SELECT *, {full(10, 'close')} AS ss, {full(20, 'close')} AS sl, 100 * {pct('close', lag('close', 10))} AS roc,"
    f" {TR80} AS tr, row_number() OVER ({OVER}) AS rn FROM bars)",
    f"m2 AS (SELECT *, {full(14, 'tr')} AS atr, 100 * {pct('ss', 'sl')} AS tstr, {lag('ss')} AS pss, {lag('sl')} AS psl FROM m1)",
    "m3 AS (SELECT *, rn >= 21 AND ss IS NOT NULL AND atr IS NOT NULL AS ready,"
    " coalesce(ss < sl AND pss >= psl, false) AS crossed, coalesce(roc < -0.5, false) AS rev, coalesce(tstr < -0.5, false) AS turned FROM m2)",
    "sg AS (SELECT *, " + outcome("coalesce(ready AND roc > 0.5 AND ss > sl, false)",
                                  "coalesce(ready AND roc < -0.5 AND NOT coalesce(ss > sl, false), false)", "2 * atr", "3 * atr",
                                  ("printf('Bullish_Momentum_ROC=%.2f%%', roc)", "printf('Bearish_Momentum_ROC=%.2f%%', roc)"))
    + " FROM m3)",
]
on_rule("f10_momentum_80_20", sig.momentum_80_20_rule(), "", [BARS, *M80])
on_rule("f11_momentum_80_20_exits", sig.momentum_80_20_rule(), "", [BARS, *M80], entries_only=False, extra={
    "exit_long": flag("ready AND (crossed OR rev OR turned)"),
    "exit_reason": "CASE WHEN ready AND crossed THEN 'SMA_Crossover' WHEN ready AND rev THEN 'Momentum_Reversal'"
    " WHEN ready AND turned THEN 'Trend_Reversal' END",
})


# ---- model rules on walk-forward scores of fitted models ------------------------------

SCORED = [*base(), *score_sql(), "sc AS MATERIALIZED (SELECT z2.*, scores.* EXCLUDE (symbol, ts) FROM z2 JOIN scores USING (symbol, ts))"]
CONF = "greatest(prob_up, 1 - prob_up)"


@query("f06_model_signals", pick(
    [BARS, *SCORED, *V1, PARAMS, f"cl AS (SELECT symbol, ts, {AS_OF} AS regime FROM r3)",
     "j AS (SELECT sc.*, params.* FROM sc JOIN cl USING (symbol, ts) JOIN params USING (regime))",
     "sg AS (SELECT *, " + outcome(f"(rn >= 200 AND {CONF} >= confidence_threshold AND prob_up > 0.5)",
                                   f"(rn >= 200 AND {CONF} >= confidence_threshold AND prob_up <= 0.5)",
                                   "stop_loss_atr_mult * sd", "take_profit_atr_mult * sd", ("'b'", "'s'")) + " FROM j)"],
    "sg", KEYS, {"action": "action", "stop_loss": "d:stop_loss", "take_profit": "d:take_profit",
                 "confidence": "d4:" + CONF}, where="action IS NOT NULL"))
def model_signals(spark, sf_dir):
    regimes = reg.with_regime_parameters(reg.regime_as_of(event_bars(spark, sf_dir)).select(*KEYS, "regime"))
    out = sig.entries(sig.model_rule(scored_bars(spark, sf_dir).join(regimes, KEYS)))
    return rounded(out.select(*KEYS, "action", "stop_loss", "take_profit", "confidence"), confidence=4)


@query("f07_model_exits", pick([BARS, *SCORED], "sc", KEYS, {
    "exit_long": flag("rn >= 200 AND NOT prob_up > 0.5"), "exit_short": flag("rn >= 200 AND prob_up > 0.5")}))
def model_exits(spark, sf_dir):
    out = sig.model_rule(scored_bars(spark, sf_dir), regime_adaptive=False)
    return out.select(*KEYS, "exit_long", "exit_short")


ATR_OK = "(rn >= 60 AND atr IS NOT NULL)"


@query("f12_long_only_model", pick(
    [BARS, *SCORED, "sg AS (SELECT *, " + outcome(f"({ATR_OK} AND prob_up > 0.5 AND {CONF} >= 0.6)", "false", "2 * atr", "3 * atr",
                                                  ("'b'", "'s'")) + " FROM sc)"],
    "sg", KEYS, {"action": "action", "stop_loss": "d:stop_loss", "take_profit": "d:take_profit",
                 "exit_long": flag(f"{ATR_OK} AND prob_up <= 0.5")}))
def long_only(spark, sf_dir):
    out = sig.long_only_model_rule(scored_bars(spark, sf_dir))
    return rounded(out.select(*KEYS, "action", "stop_loss", "take_profit", "exit_long"))


def agreement_sql(k, thr, scores=HORIZON_SCORES):
    ups = " + ".join(f"CAST({p} > 0.5 AND {p} >= {thr} AS INTEGER)" for p in scores)
    downs = " + ".join(f"CAST({p} <= 0.5 AND 1 - {p} >= {thr} AS INTEGER)" for p in scores)
    total = " + ".join(f"CASE WHEN {p} > 0.5 THEN {p} ELSE 0 END" for p in scores)
    n = " + ".join(f"CAST({p} > 0.5 AS INTEGER)" for p in scores)
    return pick(
        [BARS, *SCORED, f"ag AS (SELECT *, {ups} AS up_votes, {downs} AS down_votes, ({total}) / nullif({n}, 0) AS conf FROM sc)",
         "sg AS (SELECT *, " + outcome(f"({ATR_OK} AND up_votes >= {k})", "false", "2 * atr", "3 * atr", ("'b'", "'s'")) + " FROM ag)"],
        "sg", KEYS, {"action": "action", "stop_loss": "d:stop_loss", "up_votes": "up_votes", "down_votes": "down_votes",
                     "confidence": "d4:conf", "exit_long": flag(f"{ATR_OK} AND down_votes >= {k}")})


AGREE_COLS = ["action", "stop_loss", "up_votes", "down_votes", "confidence", "exit_long"]


@query("f14_horizon_agreement", agreement_sql(3, 0.6))
def horizons(spark, sf_dir):
    return rounded(sig.agreement_rule(scored_bars(spark, sf_dir), HORIZON_SCORES).select(*KEYS, *AGREE_COLS), confidence=4)


@query("f15_model_agreement", agreement_sql(2, 0.55))
def models(spark, sf_dir):
    out = sig.agreement_rule(scored_bars(spark, sf_dir), HORIZON_SCORES, 0.55, 2, label="ENSEMBLE")
    return rounded(out.select(*KEYS, *AGREE_COLS), confidence=4)


STOPS = "CASE regime_name WHEN 'VOLATILE' THEN 3.0 WHEN 'BULL' THEN 1.5 WHEN 'BEAR' THEN 1.0 ELSE 2.0 END"
GAINS = "CASE regime_name WHEN 'VOLATILE' THEN 2.0 WHEN 'BULL' THEN 3.0 WHEN 'BEAR' THEN 2.0 ELSE 2.5 END"


def regime_sql(prob, skip):
    conf = f"greatest({prob}, 1 - {prob})"
    ready = f"(rn >= 200 AND NOT {skip} AND {conf} >= greatest(0.5, least(0.9, 0.6 + adj)))"
    return [
        BARS, *SCORED, *V2, SETTINGS,
        "j AS (SELECT sc.*, regime_name, adj, position_multiplier, use_balanced FROM sc JOIN"
        " (SELECT symbol, ts, regime_name FROM t5) USING (symbol, ts) JOIN settings USING (regime_name))",
        f"sg AS (SELECT *, {conf} AS conf, {ready} AS ready, "
        + outcome(f"({ready} AND {prob} > 0.5)", f"({ready} AND {prob} <= 0.5)", f"{STOPS} * atr", f"{GAINS} * atr", ("'b'", "'s'"))
        + " FROM j)",
    ]


REGIME_COLS = {
    "regime_name": "regime_name", "action": "action", "stop_loss": "d:stop_loss", "take_profit": "d:take_profit",
    "size_mult": "position_multiplier",
    "exit_long": flag("ready AND conf >= CASE WHEN regime_name IN ('VOLATILE', 'BEAR') THEN 0.5 ELSE 0.55 END"),
}


def regime_scored(spark, sf_dir, **kw):
    scored = scored_bars(spark, sf_dir)
    return reg.with_adaptive_settings(reg.classify_range_regime(reg.regime_inputs(scored)), 0.6, **kw)


@query("f16_regime_model", pick(regime_sql("prob_up", "(regime_name = 'VOLATILE')"), "sg", KEYS, REGIME_COLS))
def regime_model(spark, sf_dir):
    out = sig.regime_model_rule(regime_scored(spark, sf_dir, skip_volatile=True))
    return rounded(out.select(*KEYS, *REGIME_COLS))


@query("f17_regime_two_models",
       pick(regime_sql("(CASE WHEN use_balanced THEN prob_balanced ELSE prob_up END)", "false"), "sg", KEYS, REGIME_COLS))
def two_models(spark, sf_dir):
    out = sig.regime_model_rule(regime_scored(spark, sf_dir), balanced_probability="prob_balanced")
    return rounded(out.select(*KEYS, *REGIME_COLS))


@query("f18_signal_rates", stages(*regime_sql("prob_up", "false")) + f"""
SELECT symbol, regime_name, count(*) AS signals, count(*) FILTER (WHERE action IS NOT NULL) AS trades,
  {r("100.0 * count(*) FILTER (WHERE action IS NOT NULL) / count(*)")} AS trade_rate FROM sg GROUP BY symbol, regime_name""")
def rates(spark, sf_dir):
    return rounded(sig.signal_rates(sig.regime_model_rule(regime_scored(spark, sf_dir))))


@query("f19_custom_rule", pick([BARS, f"sg AS (SELECT *, {lag('close')} AS pk FROM bars)"], "sg", KEYS, {
    "action": "CASE WHEN close > 1.1 * pk THEN 'buy' END", "stop_loss": "d:CASE WHEN close > 1.1 * pk THEN 0.9 * close END"}))
def custom(spark, sf_dir):
    """A user's rule: buy after a jump of more than ten percent."""
    def jump(bars):
        stepped = ind.indicator(1, lambda f: {"before": f.lag("close")})(bars)
        up = F.col("close") > 1.1 * F.col("before")
        return stepped.withColumns({
            "action": F.when(up, "buy"), "stop_loss": F.when(up, 0.9 * F.col("close")),
            "take_profit": F.when(up, 1.2 * F.col("close")), "reason": F.when(up, "jump"),
        })

    return rounded(sig.custom_rule(event_bars(spark, sf_dir), jump).select(*KEYS, "action", "stop_loss"))
RULES_ALL = sig.momentum_rule(10, 30)
