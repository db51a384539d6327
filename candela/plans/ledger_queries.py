"""Ledger, sizing and equity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import indicators as ind
from candela.operators import ledger as led
from candela.operators import signals as sig
from candela.plans.registry import query
from candela.plans.signal_queries import FAST, base
from candela.plans.sqltext import BARS, TRADE_ORDER, TRADES, r, rounded
from candela.sources.driver_tables import event_bars, line_trades, trade_series

RULE = sig.momentum_rule(10, 30)
CFG = led.BacktestConfig()
H, S, C = CFG.half_spread, CFG.slippage_pct, CFG.commission_pct


def recursive(*ctes):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def fill(price, lng, entering):
    """Price after half the spread and slippage, against the trader."""
    worse = lng if entering else f"NOT {lng}"
    return f"(CASE WHEN {worse} THEN {price} * (1 + {H!r}) * (1 + {S!r}) ELSE {price} * (1 - {H!r}) * (1 - {S!r}) END)"


def share(entry, stop):
    return (
        f"(CASE WHEN {stop} IS NULL OR {stop} = 0 THEN 0.02 / {entry} WHEN abs({entry} - {stop}) = 0 THEN 0"
        f" ELSE least(0.02 / nullif(abs({entry} - {stop}), 0), 0.02 / {entry}) END)"
    )


EXIT_FLAGS = (
    "CAST(coalesce(rn >= 31 AND s10 < s30, false) AS INTEGER) AS xl, CAST(coalesce(rn >= 31 AND s10 > s30, false) AS INTEGER) AS xs"
)
RULE_SQL = [BARS, *base(), f"sg AS (SELECT *, {FAST} FROM z2)"]


def ledger_sql(where="", exits=False, source=RULE_SQL):
    """Trades by following each exit to the next signal, capital carried along."""
    flag_l = "OR b.xl = 1" if exits else ""
    flag_s = "OR b.xs = 1" if exits else ""
    hit_l = "b.low <= nullif(c.stop_loss, 0) OR b.high >= nullif(c.take_profit, 0)"
    hit_s = "b.high >= nullif(c.stop_loss, 0) OR b.low <= nullif(c.take_profit, 0)"
    by_signal = ("AND NOT coalesce(CASE WHEN c.lng THEN " + hit_l + " ELSE " + hit_s + " END, false)") if exits else "AND false"
    return [
        *source,
        f"p AS (SELECT *, action = 'buy' AS lng, {fill('close', chr(40) + 'action = ' + chr(39) + 'buy' + chr(39) + chr(41), True)} AS entry,"
        " " + (EXIT_FLAGS if exits else "0 AS xl, 0 AS xs") + " FROM sg)",
        f"cand AS (SELECT * FROM (SELECT *, {share('entry', 'stop_loss')} AS share FROM p WHERE action IS NOT NULL) WHERE share > 0 {where})",
        "lastb AS (SELECT symbol, max(rn) AS lrn, max(ts) AS lts, arg_max(close, rn) AS lclose FROM p GROUP BY symbol)",
        f"tch AS (SELECT c.symbol, c.rn, min(b.rn) AS xrn FROM cand c JOIN p b ON b.symbol = c.symbol AND b.rn > c.rn"
        f" AND (CASE WHEN c.lng THEN {hit_l} {flag_l} ELSE {hit_s} {flag_s} END) GROUP BY c.symbol, c.rn)",
        f"ex AS (SELECT c.*, coalesce(t.xrn, l.lrn + 1) AS exit_rn, coalesce(b.ts, l.lts) AS exit_time, coalesce(b.close, l.lclose) AS xmid,"
        f" CASE WHEN b.rn IS NULL THEN 'end_of_backtest' WHEN coalesce(CASE WHEN c.lng THEN b.low <= nullif(c.stop_loss, 0) ELSE b.high >= nullif(c.stop_loss, 0) END, false)"
        f" THEN 'stop_loss' WHEN coalesce(CASE WHEN c.lng THEN b.high >= nullif(c.take_profit, 0) ELSE b.low <= nullif(c.take_profit, 0) END, false) THEN 'take_profit' ELSE 'signal' END AS exit_reason,"
        f" CASE WHEN b.rn IS NOT NULL {by_signal} THEN t.xrn + 1 ELSE coalesce(t.xrn, l.lrn + 1) END AS free_from"
        " FROM cand c JOIN lastb l USING (symbol) LEFT JOIN tch t ON t.symbol = c.symbol AND t.rn = c.rn"
        " LEFT JOIN p b ON b.symbol = c.symbol AND b.rn = t.xrn)",
        f"ex2 AS (SELECT *, {fill('xmid', 'lng', False)} AS xprice FROM ex)",
        f"ex3 AS (SELECT *, (CASE WHEN lng THEN xprice - entry ELSE entry - xprice END) - {C!r} * (entry + xprice) AS unit FROM ex2)",
        "nx AS (SELECT a.symbol, a.rn, min(b.rn) AS nxt FROM ex3 a JOIN cand b ON b.symbol = a.symbol AND b.rn >= a.free_from GROUP BY a.symbol, a.rn)",
        "led AS (SELECT e.symbol, e.rn, CAST(10000 AS DOUBLE) AS cap, 10000 * (1 + e.share * e.unit) AS cap2 FROM ex3 e"
        " WHERE e.rn = (SELECT min(c.rn) FROM cand c WHERE c.symbol = e.symbol)"
        " UNION ALL SELECT e.symbol, e.rn, l.cap2, l.cap2 * (1 + e.share * e.unit) FROM led l JOIN nx n ON n.symbol = l.symbol AND n.rn = l.rn"
        " JOIN ex3 e ON e.symbol = n.symbol AND e.rn = n.nxt WHERE l.cap2 > 0)",
        "tr AS (SELECT e.symbol, e.rn AS entry_rn, e.exit_rn, e.ts AS entry_time, e.exit_time, CASE WHEN e.lng THEN 'long' ELSE 'short' END AS direction,"
        " e.lng, e.entry AS entry_price, e.xprice AS exit_price, e.share * l.cap AS size, e.share * l.cap * e.unit AS pnl,"
        f" 100 * e.unit / e.entry AS pnl_percent, e.share * l.cap * {C!r} * (e.entry + e.xprice) AS commission,"
        f" e.share * l.cap * {S!r} * e.xmid * (CASE WHEN e.lng THEN 1 - {H!r} ELSE 1 + {H!r} END) AS slippage,"
        " e.reason AS entry_reason, e.exit_reason, l.cap AS capital_before, l.cap2 AS capital_after, e.share"
        " FROM led l JOIN ex3 e ON e.symbol = l.symbol AND e.rn = l.rn)",
    ]


MARKED = (
    "mk AS (SELECT b.symbol, b.ts, b.rn, b.close, t.entry_rn, t.exit_rn, t.capital_before, t.capital_after,"
    f" t.size * (CASE WHEN t.lng THEN b.close * (1 - {H!r}) - t.entry_price ELSE t.entry_price - b.close * (1 + {H!r}) END) AS gain"
    " FROM p b ASOF LEFT JOIN tr t ON t.symbol = b.symbol AND t.entry_rn < b.rn)"
)
EQUITY = (
    "eq AS (SELECT symbol, ts, rn, entry_rn, exit_rn, gain, CASE WHEN entry_rn IS NULL THEN 10000 WHEN rn < exit_rn THEN capital_before + gain"
    " ELSE capital_after END AS equity FROM mk)"
)
LEDGER = ledger_sql()


def signals(spark, sf_dir):
    return RULE(event_bars(spark, sf_dir), keep_helpers=True)


CORE = ["symbol", "entry_time", "exit_time", "direction", "entry_price", "exit_price", "entry_reason", "exit_reason"]
DOUBLES = {"entry_price", "exit_price", "size", "pnl", "pnl_percent", "commission", "slippage", "capital_before",
           "capital_after", "equity", "max_adverse_excursion", "max_favorable_excursion"}


def columns(names, digits=4):
    return ", ".join(f"{r(n, digits)} AS {n}" if n in DOUBLES else n for n in names)


@query("g01_ledger", recursive(*LEDGER) + f"SELECT {columns(CORE)} FROM tr")
def ledger(spark, sf_dir):
    return rounded(led.ledger(signals(spark, sf_dir)).select(*CORE), 4)


@query("g01_ledger_exit_signals", recursive(*ledger_sql(exits=True)) + f"SELECT {columns(CORE)} FROM tr")
def ledger_exits(spark, sf_dir):
    cfg = led.sweep(CFG, use_exit_signals=True)
    return rounded(led.ledger(signals(spark, sf_dir), cfg).select(*CORE), 4)


@query("g02_trading_window", recursive(*ledger_sql("AND ts >= TIMESTAMP '2024-01-12'")) + f"SELECT {columns(CORE)} FROM tr")
def window(spark, sf_dir):
    return rounded(led.ledger(signals(spark, sf_dir), start="2024-01-12").select(*CORE), 4)


SIGNALS_SQL = [BARS, *base(), f"sg AS (SELECT *, {FAST} FROM z2)", "e AS (SELECT *, action = 'buy' AS lng FROM sg WHERE action IS NOT NULL)"]


@query("g03_fills", recursive(*SIGNALS_SQL) + f"SELECT symbol, ts, action, {r(fill('close', 'lng', True))} AS entry_fill,"
       f" {r(fill('close', 'lng', False))} AS exit_fill FROM e")
def fills(spark, sf_dir):
    e = sig.entries(RULE(event_bars(spark, sf_dir)))
    long, close = F.col("action") == "buy", F.col("close")
    return rounded(e.select("symbol", "ts", "action", led.entry_fill(close, long, CFG).alias("entry_fill"),
                            led.exit_fill(close, long, CFG).alias("exit_fill")))


PNL = ["symbol", "entry_time", "size", "pnl", "pnl_percent", "commission", "slippage"]


@query("g04_pnl", recursive(*LEDGER) + f"SELECT {columns(PNL)} FROM tr")
def pnl(spark, sf_dir):
    return rounded(led.ledger(signals(spark, sf_dir)).select(*PNL), 4)


@query("g05_fixed_risk_size", recursive(*SIGNALS_SQL, f"f AS (SELECT *, {fill('close', 'lng', True)} AS en FROM e)")
       + f"SELECT symbol, ts, {r('10000 * ' + share('en', 'stop_loss'))} AS size FROM f")
def fixed_size(spark, sf_dir):
    e = sig.entries(RULE(event_bars(spark, sf_dir)))
    entry = led.entry_fill(F.col("close"), F.col("action") == "buy", CFG)
    return rounded(e.select("symbol", "ts", (10000 * led.fixed_risk_share(entry, F.col("stop_loss"), CFG)).alias("size")))


@query("g06_atr_size", recursive(*SIGNALS_SQL, f"f AS (SELECT *, {fill('close', 'lng', True)} AS en FROM e)")
       + f"SELECT symbol, ts, {r('10000 * CASE WHEN atr IS NULL OR atr = 0 THEN 0.02 / en ELSE least(0.02 / (2 * atr), 0.02 / en) END')} AS size FROM f")
def atr_size(spark, sf_dir):
    part = ind.beside(ind.atr(14), RULE.build(""))
    e = sig.entries(part(event_bars(spark, sf_dir)))
    entry = led.entry_fill(F.col("close"), F.col("action") == "buy", CFG)
    return rounded(e.select("symbol", "ts", (10000 * led.atr_risk_share(entry, F.col("atr_14"), CFG)).alias("size")))


PAST = f"(PARTITION BY instrument ORDER BY {TRADE_ORDER} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"


@query("g07_kelly", recursive(
    TRADES,
    f"k AS (SELECT trade_id, instrument, row_number() OVER (PARTITION BY instrument ORDER BY {TRADE_ORDER}) AS rn,"
    f" count(*) FILTER (WHERE pnl > 0) OVER {PAST} / nullif(count(*) OVER {PAST}, 0) AS wr,"
    f" avg(pnl) FILTER (WHERE pnl > 0) OVER {PAST} AS aw, abs(avg(pnl) FILTER (WHERE pnl < 0) OVER {PAST}) AS al FROM trades)")
    + f"""SELECT trade_id, instrument, {r('''CASE WHEN rn - 1 > 20 AND aw IS NOT NULL AND al IS NOT NULL THEN
    CASE WHEN al <> 0 AND wr > 0 AND wr < 1 THEN greatest(0.001, least(0.05, (wr * aw / al - (1 - wr)) / nullif(aw / al, 0) * 0.5)) ELSE 0.01 END END''')}
    AS kelly_fraction FROM k""")
def kelly(spark, sf_dir):
    return rounded(led.kelly_sizes(line_trades(spark, sf_dir), trade_series()).select("trade_id", "instrument", "kelly_fraction"))


CAP = ["symbol", "entry_time", "capital_before", "capital_after"]


@query("g08_compounding", recursive(*LEDGER) + f"SELECT {columns(CAP)} FROM tr")
def capital(spark, sf_dir):
    return rounded(led.ledger(signals(spark, sf_dir)).select(*CAP), 4)


def test_of(spark, sf_dir, **changes):
    return led.backtest(signals(spark, sf_dir), led.sweep(CFG, max_drawdown_pct=1.0, **changes))


MAE = ["symbol", "entry_time", "max_adverse_excursion", "max_favorable_excursion"]


@query("g09_excursions", recursive(*LEDGER, MARKED,
       "mm AS (SELECT symbol, entry_rn, min(gain) AS lo, max(gain) AS hi FROM mk WHERE rn <= exit_rn GROUP BY ALL)")
       + f"SELECT tr.symbol, entry_time, {r('coalesce(least(lo, 0), 0)', 4)} AS max_adverse_excursion,"
       f" {r('coalesce(greatest(hi, 0), 0)', 4)} AS max_favorable_excursion FROM tr LEFT JOIN mm USING (symbol, entry_rn)")
def mae(spark, sf_dir):
    return rounded(test_of(spark, sf_dir).trades.select(*MAE), 4)


@query("g10_equity", recursive(*LEDGER, MARKED, EQUITY) + f"SELECT symbol, ts, {r('equity', 4)} AS equity FROM eq")
def equity(spark, sf_dir):
    return rounded(test_of(spark, sf_dir).equity.select("symbol", "ts", "equity"), 4)


HALT = [
    "pk AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS peak FROM eq)",
    "hl AS (SELECT symbol, min(rn) AS halt_rn FROM pk WHERE (peak - equity) / peak > 0.05 GROUP BY symbol)",
    "hc AS (SELECT t.*, coalesce(t.exit_rn > h.halt_rn, false) AS cut, h.halt_rn, l.lts, l.lclose FROM tr t LEFT JOIN hl h USING (symbol)"
    " JOIN lastb l USING (symbol) WHERE h.halt_rn IS NULL OR t.entry_rn <= h.halt_rn)",
    f"hd AS (SELECT *, CASE WHEN cut THEN {fill('lclose', 'lng', False)} ELSE exit_price END AS xp FROM hc)",
]


@query("g11_drawdown_halt", recursive(*LEDGER, MARKED, EQUITY, *HALT) + f"""
SELECT symbol, entry_time, CASE WHEN cut THEN lts ELSE exit_time END AS exit_time, {r('xp', 4)} AS exit_price,
  {r(f'CASE WHEN cut THEN size * ((CASE WHEN lng THEN xp - entry_price ELSE entry_price - xp END) - {C!r} * (entry_price + xp)) ELSE pnl END', 4)} AS pnl,
  CASE WHEN cut THEN 'end_of_backtest' ELSE exit_reason END AS exit_reason FROM hd""")
def halted(spark, sf_dir):
    bt = led.backtest(signals(spark, sf_dir), led.sweep(CFG, max_drawdown_pct=0.05))
    return rounded(bt.trades.select("symbol", "entry_time", "exit_time", "exit_price", "pnl", "exit_reason"), 4)


@query("g12_ledger_equity", recursive(
    TRADES, f"s AS (SELECT instrument, exit_time AS ts, row_number() OVER w AS step, 10000 + sum(pnl) OVER (w ROWS UNBOUNDED PRECEDING) AS equity"
    f" FROM trades WINDOW w AS (PARTITION BY instrument ORDER BY {TRADE_ORDER}))")
    + f"SELECT instrument, ts, step, {r('equity', 4)} AS equity FROM s UNION ALL"
    " SELECT instrument, min(entry_time), 0, 10000.0 FROM trades GROUP BY instrument")
def ledger_curve(spark, sf_dir):
    return rounded(led.ledger_equity(line_trades(spark, sf_dir), trade_series()), 4)


DESC_ORDER = ", ".join(f"{n} DESC" for n in TRADE_ORDER.split(", "))
LAST20 = [
    f"rk AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY {DESC_ORDER}) AS rr, count(*) OVER (PARTITION BY instrument) AS n FROM trades)",
    "st AS (SELECT instrument, max(n) AS trades, count(*) FILTER (WHERE pnl > 0) / 20.0 AS win_rate,"
    " coalesce(avg(pnl_percent) / nullif(stddev_pop(pnl_percent), 0), 0) * sqrt(252) AS sharpe FROM rk WHERE rr <= 20 GROUP BY instrument)",
]
LADDER = ("CASE WHEN trades < 20 THEN 0.5 WHEN win_rate > 0.6 AND sharpe > 1.5 THEN 1.5 WHEN win_rate > 0.55 AND sharpe > 1 THEN 1.2"
          " WHEN win_rate > 0.5 AND sharpe > 0.5 THEN 1.0 WHEN win_rate > 0.45 AND sharpe > 0 THEN 0.75 WHEN win_rate > 0.4 THEN 0.5 ELSE 0.25 END")


@query("g13_performance_multiplier", recursive(TRADES, *LAST20)
       + f"SELECT instrument, trades, {r('win_rate')} AS win_rate, {r('sharpe')} AS sharpe, CAST({LADDER} AS DOUBLE) AS size_multiplier FROM st")
def multiplier(spark, sf_dir):
    s = trade_series()
    return rounded(led.performance_multiplier(line_trades(spark, sf_dir), ["instrument"], list(s.order)))


@query("g14_orders_intent", recursive(
    *LEDGER,
    "rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_time DESC, entry_rn DESC) AS rr, count(*) OVER (PARTITION BY symbol) AS n FROM tr)",
    LAST20[1].replace("instrument", "symbol"), f"ml AS (SELECT symbol, {LADDER} AS m FROM st)")
    + "SELECT c.symbol, c.ts, c.action, CAST(floor(200 / nullif(abs(c.close - c.stop_loss), 0) * coalesce(m, 0.5)) AS BIGINT)"
    " * (CASE WHEN c.action = 'buy' THEN 1 ELSE -1 END) AS units FROM sg c LEFT JOIN ml USING (symbol) WHERE c.action IS NOT NULL")
def intent(spark, sf_dir):
    s = signals(spark, sf_dir)
    m = led.performance_multiplier(led.ledger(s), ["symbol"], ["exit_time", "entry_rn"])
    return led.orders_intent(sig.entries(s), m, ["symbol"]).select("symbol", "ts", "action", "units")
