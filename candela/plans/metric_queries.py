"""Metric queries: on trades from order lines per instrument, and on a back-test of event bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.series import bar_series
from candela.operators import metrics as met
from candela.plans.ledger_queries import EQUITY, LEDGER, MARKED, recursive, test_of
from candela.plans.registry import query
from candela.plans.sqltext import TRADE_ORDER, TRADES, pct, r, rounded, stages
from candela.sources.driver_tables import event_bars, line_trades, pnl_trades, trade_series

K = ["instrument"]
ORDER = list(trade_series().order)
Y = "sqrt(252)"


def cols(spec, digits=4):
    return ", ".join(f"{r(e, digits)} AS {n}" for n, e in spec.items())


STATS = {
    "total_pnl": "sum(pnl)", "gross_profit": "coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0)",
    "gross_loss": "abs(coalesce(sum(pnl) FILTER (WHERE pnl < 0), 0))", "avg_win": "coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0)",
    "avg_loss": "abs(coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0))", "win_rate": "avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END)",
    "profit_factor": "coalesce(sum(pnl) FILTER (WHERE pnl > 0) / nullif(abs(sum(pnl) FILTER (WHERE pnl < 0)), 0), 0)",
    "expectancy": "avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) * coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0)"
    " - (1 - avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END)) * abs(coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0))",
}
COUNTS = ("count(*) AS total_trades, count(*) FILTER (WHERE pnl > 0) AS winning_trades,"
          " count(*) FILTER (WHERE pnl <= 0) AS losing_trades")


@query("i01_trade_stats", stages(TRADES) + f"SELECT instrument, {COUNTS}, {cols(STATS)} FROM trades GROUP BY instrument")
def stats(spark, sf_dir):
    return rounded(met.trade_stats(line_trades(spark, sf_dir), K), 4)


RETURNS = [
    *LEDGER, MARKED, EQUITY,
    "rt AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret,"
    " max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM eq)",
    "dd AS (SELECT *, (equity - peak) / peak AS drawdown FROM rt)",
]
SHARPE = f"coalesce({Y} * (avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret), 0), 0)"
SORTINO = f"coalesce({Y} * (avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret) FILTER (WHERE ret < 0), 0), 0)"


def curve(spark, sf_dir):
    return met.equity_returns(test_of(spark, sf_dir).equity, bar_series())


@query("i02_sharpe", recursive(*RETURNS) + f"SELECT symbol, {r(SHARPE)} AS sharpe_ratio FROM dd GROUP BY symbol")
def sharpe(spark, sf_dir):
    return rounded(met.ratio_stats(curve(spark, sf_dir), ["symbol"]).select("symbol", "sharpe_ratio"))


@query("i03_sortino", recursive(*RETURNS) + f"SELECT symbol, {r(SORTINO)} AS sortino_ratio FROM dd GROUP BY symbol")
def sortino(spark, sf_dir):
    return rounded(met.ratio_stats(curve(spark, sf_dir), ["symbol"]).select("symbol", "sortino_ratio"))


@query("i04_drawdown", recursive(*RETURNS) + f"SELECT symbol, ts, {r('drawdown')} AS drawdown FROM dd")
def drawdown(spark, sf_dir):
    return rounded(curve(spark, sf_dir).select("symbol", "ts", "drawdown"))


RUNS = [
    "i1 AS (SELECT *, coalesce(drawdown < 0, false) AS down FROM dd)",
    "i2 AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, down ORDER BY ts) AS island FROM i1)",
    "i3 AS (SELECT symbol, count(*) AS n FROM i2 WHERE down GROUP BY symbol, island)",
    "i4 AS (SELECT symbol, max(n) AS bars FROM i3 GROUP BY symbol)",
]


@query("i05_drawdown_duration", recursive(*RETURNS, *RUNS)
       + f"SELECT dd.symbol, {r('abs(min(drawdown))')} AS max_drawdown, {r('abs(arg_max(drawdown, ts))')} AS current_drawdown,"
       " coalesce(max(bars), 0) AS max_drawdown_duration_bars FROM dd LEFT JOIN i4 USING (symbol) GROUP BY dd.symbol")
def durations(spark, sf_dir):
    return rounded(met.drawdown_stats(curve(spark, sf_dir), bar_series()))


TOTAL = "(arg_max(equity, ts) - arg_min(equity, ts)) / arg_min(equity, ts)"


@query("i06_returns", recursive(*RETURNS) + f"SELECT symbol, {r('arg_max(equity, ts)', 4)} AS final_equity, count(*) AS points,"
       f" {r(TOTAL)} AS total_return, {r(TOTAL + ' * 252.0 / count(*)')} AS annual_return FROM eq GROUP BY symbol")
def returns(spark, sf_dir):
    return rounded(met.return_stats(test_of(spark, sf_dir).equity, ["symbol"]), final_equity=4)


HOURS = "avg(date_diff('second', entry_time, exit_time) / 3600.0)"


@query("i07_trade_duration", stages(TRADES) + f"SELECT instrument, {r(HOURS, 4)} AS avg_trade_duration_hours FROM trades GROUP BY instrument")
def hours(spark, sf_dir):
    df = line_trades(spark, sf_dir).groupBy(*K).agg(F.avg(met.duration_hours()).alias("avg_trade_duration_hours"))
    return rounded(df, 4)


STREAK = [
    TRADES, f"s1 AS (SELECT *, pnl > 0 AS win, row_number() OVER (PARTITION BY instrument ORDER BY {TRADE_ORDER}) AS rn FROM trades)",
    f"s2 AS (SELECT *, rn - row_number() OVER (PARTITION BY instrument, win ORDER BY {TRADE_ORDER}) AS island FROM s1)",
    "s3 AS (SELECT instrument, win, count(*) AS n FROM s2 GROUP BY instrument, win, island)",
]


@query("i08_streaks", stages(*STREAK) + "SELECT instrument, coalesce(max(n) FILTER (WHERE win), 0) AS max_consecutive_wins,"
       " coalesce(max(n) FILTER (WHERE NOT win), 0) AS max_consecutive_losses FROM s3 GROUP BY instrument")
def streaks(spark, sf_dir):
    return met.streaks(line_trades(spark, sf_dir), trade_series())


MM = "mm AS (SELECT symbol, entry_rn, least(min(gain), 0) AS lo, greatest(max(gain), 0) AS hi FROM mk WHERE rn <= exit_rn GROUP BY ALL)"


@query("i09_mae_mfe", recursive(*LEDGER, MARKED, MM) + f"SELECT symbol, {r('avg(coalesce(lo, 0))', 4)} AS avg_mae,"
       f" {r('avg(coalesce(hi, 0))', 4)} AS avg_mfe FROM tr LEFT JOIN mm USING (symbol, entry_rn) GROUP BY symbol")
def mae(spark, sf_dir):
    df = test_of(spark, sf_dir).trades.groupBy("symbol").agg(
        F.avg("max_adverse_excursion").alias("avg_mae"), F.avg("max_favorable_excursion").alias("avg_mfe"))
    return rounded(df, 4)


@query("i10_all_metrics", recursive(
    *RETURNS, *RUNS, MM,
    f"ts_ AS (SELECT symbol, {COUNTS}, {', '.join(f'{e} AS {n}' for n, e in STATS.items())}, {HOURS} AS hrs FROM tr GROUP BY symbol)",
    "w1 AS (SELECT *, pnl > 0 AS win, row_number() OVER (PARTITION BY symbol ORDER BY exit_time, entry_time) AS q FROM tr)",
    "w2 AS (SELECT *, q - row_number() OVER (PARTITION BY symbol, win ORDER BY exit_time, entry_time) AS island FROM w1)",
    "w3 AS (SELECT symbol, win, count(*) AS n FROM w2 GROUP BY symbol, win, island)",
    "w4 AS (SELECT symbol, coalesce(max(n) FILTER (WHERE win), 0) AS mcw, coalesce(max(n) FILTER (WHERE NOT win), 0) AS mcl FROM w3 GROUP BY symbol)",
    "ex_ AS (SELECT symbol, avg(coalesce(lo, 0)) AS mae, avg(coalesce(hi, 0)) AS mfe FROM tr LEFT JOIN mm USING (symbol, entry_rn) GROUP BY symbol)",
    f"eqs AS (SELECT symbol, {SHARPE} AS sharpe, {SORTINO} AS sortino, abs(min(drawdown)) AS mdd, abs(arg_max(drawdown, ts)) AS cdd,"
    f" {TOTAL} AS tot, count(*) AS n, arg_max(equity, ts) AS fin FROM dd GROUP BY symbol)") + f"""
SELECT symbol, total_trades, winning_trades, losing_trades, {cols({n: n for n in STATS})}, {r('tot * 100', 4)} AS total_return_pct,
  {r('tot * 252.0 / n * 100', 4)} AS annual_return_pct, {r('sharpe', 4)} AS sharpe_ratio, {r('sortino', 4)} AS sortino_ratio,
  {r('coalesce(tot / nullif(mdd, 0), 0)', 4)} AS calmar_ratio, {r('mdd * 100', 4)} AS max_drawdown_pct, {r('cdd * 100', 4)} AS current_drawdown_pct,
  coalesce(bars, 0) AS max_drawdown_duration_days, {r('hrs', 4)} AS avg_trade_duration_hours, mcw AS max_consecutive_wins,
  mcl AS max_consecutive_losses, {r('mae', 4)} AS avg_mae, {r('mfe', 4)} AS avg_mfe,
  {r('coalesce(total_pnl / nullif(mdd * 10000, 0), 0)', 4)} AS recovery_factor, {r('fin', 4)} AS final_equity
FROM ts_ JOIN eqs USING (symbol) JOIN w4 USING (symbol) JOIN ex_ USING (symbol) LEFT JOIN i4 USING (symbol)""")
def everything(spark, sf_dir):
    bt = test_of(spark, sf_dir)
    return rounded(met.backtest_metrics(bt.trades, bt.equity, bar_series()), 4)


DASH = {
    "total_pnl": "sum(pnl)", "avg_win": STATS["avg_win"], "avg_loss": "abs(coalesce(avg(pnl) FILTER (WHERE pnl <= 0), 0))",
    "sharpe_ratio": f"coalesce(avg(pnl_percent) / nullif(stddev_pop(pnl_percent), 0), 0) * {Y}", "max_drawdown": "abs(min(cum - peak))",
    "current_drawdown": "abs(arg_max(cum - peak, rn))", "avg_trade_duration": HOURS,
    "win_rate": "100 * " + STATS["win_rate"],
    "profit_factor": "coalesce(sum(pnl) FILTER (WHERE pnl > 0) / nullif(abs(sum(pnl) FILTER (WHERE pnl <= 0)), 0), 0)",
    "expectancy": STATS["expectancy"].replace("WHERE pnl < 0", "WHERE pnl <= 0"),
}
CUM = [
    TRADES,
    "c1 AS (SELECT *, sum(pnl) OVER w AS cum, row_number() OVER w AS rn FROM trades"
    f" WINDOW w AS (PARTITION BY instrument ORDER BY {TRADE_ORDER} ROWS UNBOUNDED PRECEDING))",
    "c2 AS (SELECT *, max(cum) OVER (PARTITION BY instrument ORDER BY rn ROWS UNBOUNDED PRECEDING) AS peak FROM c1)",
]


@query("i11_dashboard_metrics", stages(*CUM) + f"SELECT instrument, {COUNTS}, {cols(DASH)} FROM c2 GROUP BY instrument")
def dashboard(spark, sf_dir):
    return rounded(met.dashboard_metrics(line_trades(spark, sf_dir), trade_series()), 4)


@query("i12_daily_pnl", stages(TRADES) + f"SELECT instrument, CAST(exit_time AS DATE) AS day, {r('sum(pnl)', 4)} AS pnl,"
       " count(*) AS trades FROM trades GROUP BY 1, 2")
def daily(spark, sf_dir):
    return rounded(met.daily_pnl(line_trades(spark, sf_dir), K), 4)


ROLL = f"(PARTITION BY instrument ORDER BY {TRADE_ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("i13_rolling_win_rate", stages(TRADES) + f"""SELECT trade_id, instrument, {r(f'CASE WHEN count(*) OVER {ROLL} >= 10 THEN 100 * avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) OVER {ROLL} END')}
AS rolling_win_rate FROM trades""")
def rolling(spark, sf_dir):
    df = met.rolling_win_rate(line_trades(spark, sf_dir), trade_series())
    return rounded(df.select("trade_id", "instrument", "rolling_win_rate"))


@query("i14_pnl_histogram", stages(
    TRADES, "e AS (SELECT instrument, min(pnl) AS lo, max(pnl) AS hi FROM trades GROUP BY instrument)",
    "b AS (SELECT instrument, lo, (hi - lo) / 30 AS w, CAST(least(29, coalesce(floor((pnl - lo) / nullif((hi - lo) / 30, 0)), 0)) AS INTEGER) AS bin"
    " FROM trades JOIN e USING (instrument))") + f"SELECT instrument, bin, {r('any_value(lo) + bin * any_value(w)')} AS bin_start,"
    " count(*) AS trades FROM b GROUP BY instrument, bin")
def histogram(spark, sf_dir):
    return rounded(met.pnl_histogram(line_trades(spark, sf_dir), K))


@query("i15_exposure", stages(TRADES) + f"SELECT instrument, {r('sum(size * entry_price)', 2)} AS exposure FROM trades GROUP BY 1")
def exposed(spark, sf_dir):
    return rounded(met.exposure(line_trades(spark, sf_dir)), 2)


GROUP = {"pnl_sum": "sum(pnl)", "pnl_mean": "avg(pnl)", "pnl_percent_mean": "avg(pnl_percent)"}


@query("i16_by_instrument_strategy", stages(TRADES)
       + f"SELECT instrument, strategy, {cols(GROUP)}, count(*) AS trades FROM trades GROUP BY 1, 2")
def grouped(spark, sf_dir):
    return rounded(met.by_group(line_trades(spark, sf_dir), ["instrument", "strategy"]), 4)


@query("i17_by_hour", f"SELECT CAST(hour(ts) AS INTEGER) AS hour, {r('sum(value)', 4)} AS pnl_sum, count(*) AS trades FROM events GROUP BY 1")
def hourly(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("value").alias("pnl"))
    return rounded(met.by_hour(events, "ts"), 4)


DAYS = ", ".join(f"({i}, '{d}')" for i, d in enumerate(met.WEEKDAYS))


@query("i18_by_weekday", stages(TRADES, f"d(day_number, weekday) AS (VALUES {DAYS})")
       + f"SELECT day_number, weekday, {r('sum(pnl)', 4)} AS pnl_sum, count(pnl) AS trades, {r('avg(pnl)', 4)} AS pnl_mean"
       " FROM d LEFT JOIN trades ON isodow(exit_time) - 1 = day_number GROUP BY 1, 2")
def weekday(spark, sf_dir):
    return rounded(met.by_weekday(line_trades(spark, sf_dir)), 4)


DESC = ", ".join(f"{n} DESC" for n in ORDER)
NEWEST = [TRADES, f"n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY {DESC}) AS rr FROM trades)"]


@query("i19_last_ten", stages(*NEWEST) + "SELECT instrument, count(*) FILTER (WHERE pnl > 0) AS wins,"
       f" count(*) FILTER (WHERE pnl <= 0) AS losses, {r('100.0 * avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END)')} AS win_rate,"
       f" {r('sum(pnl)', 4)} AS pnl_sum, {r('avg(pnl)', 4)} AS pnl_mean FROM n WHERE rr <= 10 GROUP BY 1")
def ten(spark, sf_dir):
    return rounded(met.recent_stats(line_trades(spark, sf_dir), K, ORDER), 4, win_rate=6)


AS_OF = "2001-06-15 00:00:00"
RECENT = f"coalesce(sum(pnl) FILTER (WHERE exit_time > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND exit_time <= TIMESTAMP '{AS_OF}'), 0)"


@query("i20_limit_usage", stages(*CUM, f"u AS (SELECT instrument, {RECENT} AS d, abs(arg_max(cum - peak, rn)) AS dd, 10000 + sum(pnl) AS eq FROM c2 GROUP BY 1)")
       + f"SELECT instrument, {r('least(1, abs(d / eq) / 0.05)')} AS daily_loss_used, {r('least(1, dd / eq / 0.15)')} AS drawdown_used FROM u")
def usage(spark, sf_dir):
    trades = pnl_trades(spark, sf_dir)
    m = met.dashboard_metrics(trades, trade_series(), saved=True).join(met.recent_pnl(trades, K, AS_OF), K)
    out = met.limit_usage(m, F.col("recent_pnl"), F.col("current_drawdown"), 10000 + F.col("total_pnl"))
    return rounded(out.select(*K, "daily_loss_used", "drawdown_used"))


@query("i21_recent_pnl", stages(TRADES) + f"SELECT instrument, {r(RECENT, 4)} AS recent_pnl FROM trades GROUP BY 1")
def recent(spark, sf_dir):
    return rounded(met.recent_pnl(line_trades(spark, sf_dir), K, AS_OF), 4)


@query("i22_monthly_excess", recursive(
    *LEDGER, "hm AS (SELECT symbol, strftime(ts, '%Y-%m') AS month, 100 * "
    + pct("arg_max(close, ts)", "arg_min(close, ts)") + " AS bh FROM z0 GROUP BY 1, 2)",
    "tm AS (SELECT symbol, strftime(exit_time, '%Y-%m') AS month, count(*) AS n, 100 * sum(pnl) / 10000 AS sr FROM tr GROUP BY 1, 2)")
    + f"SELECT symbol, month, {r('bh', 4)} AS buy_hold_pct, coalesce(n, 0) AS trades, {r('coalesce(sr, 0)', 4)} AS strategy_return_pct,"
    f" {r('coalesce(sr, 0) - bh', 4)} AS excess_pct FROM hm LEFT JOIN tm USING (symbol, month)")
def excess(spark, sf_dir):
    bars = event_bars(spark, sf_dir)
    return rounded(met.monthly_excess(test_of(spark, sf_dir).trades, bars, ["symbol"]), 4)
