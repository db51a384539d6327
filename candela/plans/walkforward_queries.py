"""Walk-forward, sweep and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions.durable import materialize
from candela.functions.series import Series, bar_series, day_cells
from candela.operators import indicators as ind
from candela.operators import ledger as led
from candela.operators import metrics as met
from candela.operators import signals as sig
from candela.operators import walkforward as wf
from candela.plans.fitted_scores import HORIZON_SCORES, scored_bars
from candela.plans.ledger_queries import CFG, EQUITY, MARKED, ledger_sql, recursive
from candela.plans.metric_queries import COUNTS, SHARPE, STATS, TOTAL
from candela.plans.registry import query
from candela.plans.signal_queries import ATR_OK, BRK, FAST, M80, MOM, REV, SCORED, base, outcome
from candela.plans.sqltext import BARS, LINE_BARS, OVER, TRADE_ORDER, TRADES, r, rounded, stages
from candela.sources.driver_tables import event_bars, line_bars, line_trades, trade_series

DAILY = bar_series(86400)


def split_sql(source, train, test, step):
    w = train + test
    return [
        f"nb AS (SELECT *, row_number() OVER ({OVER}) AS rn FROM {source})",
        "ln AS (SELECT symbol, max(rn) AS n FROM nb GROUP BY symbol)",
        f"sp AS (SELECT symbol, i + 1 AS split_num, i * {step} + 1 AS train_from, i * {step} + {train} AS train_to,"
        f" i * {step} + {train + 1} AS test_from, i * {step} + {w} AS test_to"
        f" FROM ln, unnest(range((n - {w}) // {step} + 1)) u(i) WHERE n >= {w})",
        "asg AS (SELECT nb.*, split_num, CASE WHEN rn <= train_to THEN 'train' ELSE 'test' END AS role"
        " FROM nb JOIN sp ON nb.symbol = sp.symbol AND rn BETWEEN train_from AND test_to)",
    ]


BOUNDS = "symbol, split_num, train_from, train_to, test_from, test_to"


@query("j01_week_splits", stages(BARS, *split_sql("bars", 40, 10, 50)) + f"SELECT {BOUNDS} FROM sp")
def weeks(spark, sf_dir):
    return wf.week_splits(wf.series_lengths(event_bars(spark, sf_dir)))


@query("j01_week_splits_stepped", stages(BARS, *split_sql("bars", 40, 10, 5)) + f"SELECT {BOUNDS} FROM sp")
def stepped(spark, sf_dir):
    return wf.week_splits(wf.series_lengths(event_bars(spark, sf_dir)), step_weeks=1)


@query("j02_month_splits", stages(LINE_BARS, *split_sql("dbars", 252, 63, 63)) + f"SELECT {BOUNDS} FROM sp")
def months(spark, sf_dir):
    return wf.month_splits(wf.series_lengths(line_bars(spark, sf_dir)))


@query("j03_calendar_splits", stages(
    LINE_BARS, "b AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM dbars GROUP BY symbol)",
    "k AS (SELECT symbol, a, i FROM b, unnest(range((date_diff('second', a, z) - 240 * 86400) // (60 * 86400) + 1)) u(i))")
    + "SELECT symbol, i + 1 AS split_num, a + to_days(CAST(60 * i AS INTEGER)) AS train_start, a + to_days(CAST(60 * i + 180 AS INTEGER)) AS train_end,"
    " a + to_days(CAST(60 * i + 180 AS INTEGER)) AS test_start, a + to_days(CAST(60 * i + 240 AS INTEGER)) AS test_end FROM k")
def calendar(spark, sf_dir):
    return wf.calendar_splits(line_bars(spark, sf_dir))


MONTHS = ["1997-01", "1997-02", "1997-03", "1997-04"]
ITER = ("it AS (SELECT strftime(d, '%b_%Y') AS name, d - INTERVAL 12 MONTH AS a, d AS b, last_day(d) AS z FROM"
        " (VALUES (DATE '1997-01-01'), (DATE '1997-02-01'), (DATE '1997-03-01'), (DATE '1997-04-01')) v(d))")


@query("j04_month_iterations", stages(LINE_BARS, ITER) + "SELECT symbol, name, count(*) FILTER (WHERE ts < b) AS train_rows,"
       " count(*) FILTER (WHERE ts >= b) AS test_rows FROM dbars JOIN it ON CAST(ts AS DATE) >= a AND CAST(ts AS DATE) <= z"
       " GROUP BY symbol, name HAVING count(*) FILTER (WHERE ts < b) >= 50 AND count(*) FILTER (WHERE ts >= b) >= 5")
def iterations(spark, sf_dir):
    return wf.iteration_rows(line_bars(spark, sf_dir), wf.month_iterations(spark, MONTHS))


def assigned(spark, sf_dir, train=252, test=63, step=63):
    bars = line_bars(spark, sf_dir)
    return wf.assign_rows(wf.number_rows(bars, DAILY), wf.series_lengths(bars), train, test, step)


ASG = [LINE_BARS, *split_sql("dbars", 252, 63, 63)]
SUMMARY = ("sm AS (SELECT symbol, split_num, min(ts) FILTER (WHERE role = 'train') AS train_start, max(ts) FILTER (WHERE role = 'train') AS train_end,"
           " min(ts) FILTER (WHERE role = 'test') AS test_start, max(ts) FILTER (WHERE role = 'test') AS test_end,"
           " count(*) FILTER (WHERE role = 'train') AS train_rows, count(*) FILTER (WHERE role = 'test') AS test_rows FROM asg GROUP BY 1, 2)")
CHECKS = ("ov AS (SELECT symbol, split_num, count(*) FILTER (WHERE k > 1) AS overlap FROM"
          " (SELECT symbol, split_num, ts, count(DISTINCT role) AS k FROM asg GROUP BY ALL) GROUP BY ALL),"
          " ck AS (SELECT symbol, split_num, train_end < test_start AS in_order, overlap,"
          " abs(train_rows / (train_rows + test_rows) - 0.8) <= 0.05 AS ratio_ok,"
          " coalesce(lead(train_start) OVER (PARTITION BY symbol ORDER BY split_num) > test_end + INTERVAL 7 DAY, false) AS gap_after FROM sm JOIN ov USING (symbol, split_num))")


@query("c09_split_assignment", stages(*ASG) + "SELECT symbol, ts, split_num, role FROM asg")
def assignment(spark, sf_dir):
    return assigned(spark, sf_dir).select("symbol", "ts", "split_num", "role")


@query("c04_split_overlap", stages(*ASG, "bo AS (SELECT symbol, split_num, ts, count(DISTINCT role) AS k FROM asg GROUP BY ALL)")
       + "SELECT symbol, split_num, count(*) FILTER (WHERE k > 1) AS overlap FROM bo GROUP BY ALL")
def overlapping(spark, sf_dir):
    return wf.overlap(assigned(spark, sf_dir))


@query("j05_split_validation", stages(*ASG, SUMMARY, CHECKS) + "SELECT * FROM ck")
def validation(spark, sf_dir):
    return wf.validate_splits(assigned(spark, sf_dir), 0.8)


@query("j05_validation_report", stages(*ASG, SUMMARY, CHECKS) + "SELECT symbol, count(*) AS total_splits,"
       " count(*) FILTER (WHERE NOT in_order OR overlap > 0 OR NOT ratio_ok OR gap_after) AS issues,"
       " bool_and(in_order AND overlap = 0 AND ratio_ok AND NOT gap_after) AS valid FROM ck GROUP BY symbol")
def report(spark, sf_dir):
    return wf.validation_report(wf.validate_splits(assigned(spark, sf_dir), 0.8))


@query("j06_split_summary", stages(*ASG, SUMMARY) + f"SELECT *, {r('train_rows / (train_rows + test_rows)')} AS ratio FROM sm")
def summary(spark, sf_dir):
    return rounded(wf.split_summary(assigned(spark, sf_dir)))


ERA = "CASE WHEN {0} >= DATE '1999-01-01' THEN 'recent' WHEN {0} >= DATE '1995-06-01' THEN 'historical' END"


@query("j07_eras", stages(LINE_BARS, f"e AS (SELECT *, {ERA.format('CAST(ts AS DATE)')} AS dataset FROM dbars)")
       + "SELECT dataset, symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM e WHERE dataset IS NOT NULL GROUP BY 1, 2")
def datasets(spark, sf_dir):
    df = wf.eras(line_bars(spark, sf_dir), "ts", "1999-01-01", "1995-06-01")
    return df.groupBy("dataset", "symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---- back-tests keyed by split, threshold, agreement and strategy -------------------------


def keyed_series(*keys):
    return Series(tuple(keys), ("ts",), day_cells("ts", 170))


def table_of(bt, series, names):
    df = met.backtest_metrics(bt.trades, bt.equity, series)
    return df.select(*series.keys, *names)


RESULT = ["total_trades", "win_rate", "total_return_pct", "sharpe_ratio", "max_drawdown_pct", "profit_factor"]


def result_sql(source, where=""):
    """Metrics per composite symbol of a keyed back-test."""
    return [
        *ledger_sql(where, source=source), MARKED, EQUITY,
        "rt AS (SELECT *, equity / nullif(lag(equity) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS ret,"
        " max(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM eq)",
        f"es AS (SELECT symbol, {SHARPE} AS sharpe_ratio, 100 * {TOTAL} AS total_return_pct,"
        " 100 * abs(min((equity - peak) / peak)) AS max_drawdown_pct FROM rt GROUP BY symbol)",
        f"st AS (SELECT symbol, {COUNTS}, {', '.join(f'{e} AS {n}' for n, e in STATS.items())} FROM tr GROUP BY symbol)",
        "res AS (SELECT es.symbol, coalesce(total_trades, 0) AS total_trades, coalesce(win_rate, 0) AS win_rate,"
        " CASE WHEN total_trades IS NULL THEN 0 ELSE total_return_pct END AS total_return_pct,"
        " CASE WHEN total_trades IS NULL THEN 0 ELSE sharpe_ratio END AS sharpe_ratio,"
        " CASE WHEN total_trades IS NULL THEN 0 ELSE max_drawdown_pct END AS max_drawdown_pct,"
        " coalesce(profit_factor, 0) AS profit_factor, coalesce(avg_win, 0) AS avg_win, coalesce(avg_loss, 0) AS avg_loss"
        " FROM es LEFT JOIN st USING (symbol))",
    ]


def part(i):
    return f"split_part(symbol, '#', {i})"


def shown(names=RESULT):
    return ", ".join(n if n == "total_trades" else f"{r(n, 4)} AS {n}" for n in names)


FREE = led.sweep(CFG, max_drawdown_pct=1.0)
SPLIT_SIGNALS = [
    BARS, *M80[:-1],
    "sg0 AS (SELECT *, " + M80[-1].split("SELECT *, ", 1)[1].rsplit(" FROM m3", 1)[0] + " FROM m3)",
    "ln AS (SELECT symbol, max(rn) AS n FROM sg0 GROUP BY symbol)",
    "sg AS (SELECT s.symbol || '#' || (i + 1) AS symbol, s.ts, s.rn - i * 50 AS rn, s.high, s.low, s.close,"
    " CASE WHEN s.rn - i * 50 > 40 THEN s.action END AS action, s.stop_loss, s.take_profit, s.reason"
    " FROM sg0 s JOIN ln USING (symbol), unnest(range(n // 50)) u(i) WHERE s.rn BETWEEN i * 50 + 1 AND i * 50 + 50)",
]


def split_backtest(spark, sf_dir, train=40, test=10, step=50):
    """The 80/20 rule on all splits of all series in one job; entries only in the test part."""
    bars = event_bars(spark, sf_dir)
    signals = wf.number_rows(sig.momentum_80_20_rule()(bars))
    rows = wf.assign_rows(signals, wf.series_lengths(bars), train, test, step)
    rows = rows.withColumn("action", F.when(F.col("role") == "test", F.col("action")))
    series = keyed_series("symbol", "split_num")
    return led.backtest(rows, FREE, series), series


@query("j08_split_backtests", recursive(*result_sql(SPLIT_SIGNALS))
       + f"SELECT {part(1)} AS symbol, CAST({part(2)} AS BIGINT) AS split_num, {shown()} FROM res")
def split_results(spark, sf_dir):
    bt, series = split_backtest(spark, sf_dir)
    return rounded(table_of(bt, series, RESULT), 4)


def restarted_sql(warmup, train=60, test=40, step=40):
    """Signals of the breakout rule on series that begin ``warmup`` rows before each test part."""
    return [
        BARS.replace("bars AS (", "hist AS (", 1), *split_sql("hist", train, test, step),
        "bars AS (SELECT symbol || '#' || split_num AS symbol, ts, open, high, low, close, volume, role FROM asg"
        f" WHERE rn - (split_num - 1) * {step} > {train - warmup})",
        *base(), "sg0 AS (SELECT symbol, ts, high, low, close, role, " + BRK + " FROM z2)",
        f"sg AS (SELECT * EXCLUDE (role), row_number() OVER ({OVER}) AS rn FROM sg0 WHERE role = 'test')",
    ]


def restarted_backtest(spark, sf_dir, warmup, train=60, test=40, step=40):
    """Back-tests of test parts alone: indicators know the ``warmup`` rows before a part and nothing older."""
    bars = event_bars(spark, sf_dir)
    rows = wf.assign_rows(wf.number_rows(bars), wf.series_lengths(bars), train, test, step, warmup).drop("rn")
    series = keyed_series("symbol", "split_num")
    signals = sig.breakout_rule()(rows, series).where("role = 'test'")
    return rounded(table_of(led.backtest(signals, FREE, series), series, RESULT), 4)


for _name, _warmup in (("j08_restarted_backtests", 0), ("j08_warmed_up_backtests", 21)):
    query(_name, recursive(*result_sql(restarted_sql(_warmup)))
          + f"SELECT {part(1)} AS symbol, CAST({part(2)} AS BIGINT) AS split_num, {shown()} FROM res")(
        lambda spark, sf_dir, warmup=_warmup: restarted_backtest(spark, sf_dir, warmup))


THRESHOLDS = [0.50, 0.52, 0.55, 0.58, 0.60]
SWEEP = [
    BARS, *SCORED, "th(threshold) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS) + ")",
    "sg0 AS (SELECT *, " + outcome(f"({ATR_OK} AND prob_up > 0.5 AND greatest(prob_up, 1 - prob_up) >= threshold)", "false",
                                   "2 * atr", "3 * atr", ("'b'", "'s'")) + " FROM sc, th)",
    "sg AS (SELECT * REPLACE (symbol || '#' || threshold AS symbol, row_number() OVER (PARTITION BY symbol, threshold ORDER BY ts) AS rn) FROM sg0)",
]


def sweep_results(spark, sf_dir):
    """One ledger job for all thresholds: the threshold is part of the series key."""
    scored = wf.cross_parameters(scored_bars(spark, sf_dir), wf.threshold_table(spark, THRESHOLDS))
    series = keyed_series("symbol", "threshold")
    bt = led.backtest(sig.long_only_model_rule(scored, F.col("threshold")), FREE, series)
    return table_of(bt, series, [*RESULT, "avg_win", "avg_loss"])


SWEPT = [*result_sql(SWEEP), f"sw AS (SELECT {part(1)} AS sym, CAST({part(2)} AS DOUBLE) AS threshold, res.* FROM res)"]


@query("j14_threshold_sweep", recursive(*SWEPT)
       + f"SELECT sym AS symbol, threshold, {shown([*RESULT, 'avg_win', 'avg_loss'])} FROM sw")
def threshold_sweep(spark, sf_dir):
    return rounded(sweep_results(spark, sf_dir), 4, threshold=6)


@query("j15_best_per_objective", recursive(*SWEPT) + "SELECT sym AS symbol, " + ", ".join(
    f"arg_min(threshold, (-CAST({col} AS DOUBLE), threshold)) AS {n}" for n, col in wf.OBJECTIVES.items()) + " FROM sw GROUP BY sym")
def objectives(spark, sf_dir):
    return wf.best_per_objective(sweep_results(spark, sf_dir), "threshold", ["symbol"])


SCORE = " + ".join(f"({n} - min({n}) OVER q) / (max({n}) OVER q - min({n}) OVER q + 1e-6) * {w}"
                   for n, w in (("total_return_pct", 0.4), ("win_rate", 0.3), ("sharpe_ratio", 0.3)))


@query("j16_recommended_threshold", recursive(*SWEPT, f"sc_ AS (SELECT sym, threshold, {SCORE} AS score FROM sw WINDOW q AS (PARTITION BY sym))")
       + f"SELECT sym AS symbol, arg_min(threshold, (-score, threshold)) AS recommended, {r('max(score)', 4)} AS score FROM sc_ GROUP BY sym")
def recommended(spark, sf_dir):
    return rounded(wf.recommend(sweep_results(spark, sf_dir), "threshold", ["symbol"]), 4)


@query("j17_best_profitable", recursive(*SWEPT) + "SELECT sym AS symbol, arg_min(threshold, (CASE WHEN total_return_pct > 0 THEN 0 ELSE 1 END,"
       " -(CASE WHEN total_return_pct > 0 THEN sharpe_ratio ELSE total_trades END), threshold)) AS best,"
       " bool_or(total_return_pct > 0) AS any_profitable FROM sw GROUP BY sym")
def profitable(spark, sf_dir):
    return wf.best_profitable(sweep_results(spark, sf_dir), "threshold", ["symbol"])


UPS = " + ".join(f"CAST({p} > 0.5 AND {p} >= 0.55 AS INTEGER)" for p in HORIZON_SCORES)
AGREE = [
    BARS, *SCORED, "th(k) AS (VALUES (2), (3), (4))",
    "sg0 AS (SELECT *, " + outcome(f"({ATR_OK} AND ({UPS}) >= k)", "false", "2 * atr", "3 * atr", ("'b'", "'s'")) + " FROM sc, th)",
    "sg AS (SELECT * REPLACE (symbol || '#' || k AS symbol, row_number() OVER (PARTITION BY symbol, k ORDER BY ts) AS rn) FROM sg0)",
]


@query("j18_agreement_sweep", recursive(*result_sql(AGREE))
       + f"SELECT {part(1)} AS symbol, CAST({part(2)} AS INTEGER) AS agreement, {shown()} FROM res")
def agreement_sweep(spark, sf_dir):
    levels = spark.createDataFrame([(2,), (3,), (4,)], "agreement int")
    scored = wf.cross_parameters(scored_bars(spark, sf_dir), levels)
    series = keyed_series("symbol", "agreement")
    bt = led.backtest(sig.agreement_rule(scored, HORIZON_SCORES, 0.55, F.col("agreement")), FREE, series)
    return rounded(table_of(bt, series, RESULT), 4)


RULES = {"Momentum_20_50": (sig.momentum_rule(), MOM), "Momentum_10_30": (sig.momentum_rule(10, 30), FAST),
         "MeanReversion": (sig.mean_reversion_rule(), REV), "Breakout": (sig.breakout_rule(), BRK)}


def strategy_results(spark, sf_dir):
    """All strategies as keys of one ledger job."""
    bars = event_bars(spark, sf_dir)
    keep = ["symbol", "ts", "high", "low", "close", "action", "stop_loss", "take_profit", "reason"]
    stacked = None
    for name, (rule, _) in RULES.items():
        one = rule(bars).select(*keep).withColumn("strategy", F.lit(name))
        stacked = one if stacked is None else stacked.unionByName(one)
    series = keyed_series("symbol", "strategy")
    return table_of(led.backtest(stacked, FREE, series), series, RESULT)


STACK = [BARS, *base(), "sg AS (" + " UNION ALL ".join(
    f"SELECT symbol || '#{n}' AS symbol, ts, rn, high, low, close, action, stop_loss, take_profit, reason FROM (SELECT *, {sql} FROM z2)"
    for n, (_, sql) in RULES.items()) + ")"]
STRATS = [*result_sql(STACK), f"sr AS (SELECT {part(1)} AS sym, {part(2)} AS strategy, res.* FROM res)"]


@query("j19_strategy_comparison", recursive(*STRATS) + "SELECT sym AS symbol, arg_min(strategy, (-sharpe_ratio, strategy)) AS best_by_sharpe,"
       " arg_min(strategy, (-total_return_pct, strategy)) AS best_by_return, count(*) FILTER (WHERE total_return_pct > 0) AS profitable,"
       " count(*) AS strategies FROM sr GROUP BY sym")
def strategies(spark, sf_dir):
    return wf.compare_strategies(strategy_results(spark, sf_dir), ["symbol"])


@query("c10_stacked_strategies", recursive(*STRATS) + f"SELECT sym AS symbol, strategy, {shown()} FROM sr")
def stacked_strategies(spark, sf_dir):
    return rounded(strategy_results(spark, sf_dir), 4)


BH = "bh AS (SELECT symbol AS sym, (arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) AS bh FROM z0 GROUP BY symbol)"


@query("j20_verdict", recursive(*STRATS, BH) + "SELECT sym AS symbol, strategy, CASE WHEN total_trades = 0 THEN 'NO TRADES'"
       " WHEN total_return_pct > 100 * bh AND sharpe_ratio > 1 THEN 'EXCELLENT' WHEN total_return_pct > 0 AND win_rate > 0.5 THEN 'GOOD'"
       " WHEN total_return_pct > 0 THEN 'MARGINAL' ELSE 'POOR' END AS verdict FROM sr JOIN bh USING (sym)")
def verdicts(spark, sf_dir):
    held = ind.buy_and_hold(event_bars(spark, sf_dir))
    return wf.verdict(strategy_results(spark, sf_dir).join(held, "symbol")).select("symbol", "strategy", "verdict")


@query("j21_experiment_summary", recursive(*STRATS, BH) + f"SELECT sym AS symbol, strategy, total_trades, {r('win_rate', 4)} AS win_rate,"
       f" {r('total_return_pct', 4)} AS total_return_pct, {r('total_return_pct - 100 * bh', 4)} AS vs_buy_hold_pct FROM sr JOIN bh USING (sym)")
def experiments(spark, sf_dir):
    held = ind.buy_and_hold(event_bars(spark, sf_dir))
    df = wf.versus_buy_hold(strategy_results(spark, sf_dir), held, ["symbol"])
    return rounded(df.select("symbol", "strategy", "total_trades", "win_rate", "total_return_pct", "vs_buy_hold_pct"), 4)


# ---- results over splits: trades per era, strategy and month ------------------------------------

RES = [
    TRADES,
    f"d0 AS (SELECT *, {ERA.format('CAST(exit_time AS DATE)')} AS dataset, year(exit_time) * 12 + month(exit_time) - 1 AS split_num FROM trades)",
    "d1 AS (SELECT *, sum(pnl) OVER w AS cum FROM d0 WHERE dataset IS NOT NULL WINDOW w AS"
    f" (PARTITION BY dataset, strategy, split_num ORDER BY {TRADE_ORDER} ROWS UNBOUNDED PRECEDING))",
    "d2 AS (SELECT *, max(cum) OVER (PARTITION BY dataset, strategy, split_num"
    f" ORDER BY {TRADE_ORDER} ROWS UNBOUNDED PRECEDING) AS peak FROM d1)",
    "results AS (SELECT dataset, strategy, split_num, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate,"
    " sum(pnl) / 1e6 AS total_return, coalesce(avg(pnl_percent) / nullif(stddev_pop(pnl_percent), 0), 0) * sqrt(252) AS sharpe_ratio,"
    " abs(min(cum - peak)) / 1e6 AS max_drawdown,"
    " coalesce(sum(pnl) FILTER (WHERE pnl > 0) / nullif(abs(sum(pnl) FILTER (WHERE pnl <= 0)), 0), 0) AS profit_factor"
    " FROM d2 GROUP BY 1, 2, 3)",
]
GROUPED = ["dataset", "strategy"]


def split_table(spark, sf_dir):
    """One result row per era, strategy and month of closed trades, on a capital of one million."""
    trades = wf.eras(line_trades(spark, sf_dir), "exit_time", "1999-01-01", "1995-06-01")
    trades = trades.withColumn("split_num", (F.year("exit_time") * 12 + F.month("exit_time") - 1).cast("long"))
    m = met.dashboard_metrics(trades, trade_series((*GROUPED, "split_num")))
    return m.select(
        *GROUPED, "split_num", F.col("total_trades").alias("trades"), (F.col("win_rate") / 100).alias("win_rate"),
        (F.col("total_pnl") / 1e6).alias("total_return"), "sharpe_ratio", (F.col("max_drawdown") / 1e6).alias("max_drawdown"),
        "profit_factor")


AGG = {
    "avg_total_return": "avg(total_return)", "std_total_return": "stddev_pop(total_return)", "avg_sharpe_ratio": "avg(sharpe_ratio)",
    "avg_win_rate": "avg(win_rate)", "avg_max_drawdown": "avg(max_drawdown)", "max_max_drawdown": "max(max_drawdown)",
    "avg_profit_factor": "avg(profit_factor) FILTER (WHERE profit_factor > 0)",
    "positive_returns_pct": "100 * avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0 END)",
    "sharpe_above_1_pct": "100 * avg(CASE WHEN sharpe_ratio > 1 THEN 1.0 ELSE 0 END)",
    "return_consistency": "1 - stddev_pop(total_return) / (abs(avg(total_return)) + 1e-6)",
    "sharpe_consistency": "1 - stddev_pop(sharpe_ratio) / (abs(avg(sharpe_ratio)) + 1e-6)",
    "median_total_return": "median(total_return)", "median_sharpe_ratio": "median(sharpe_ratio)",
}
AGG_SQL = ", ".join(f"{r(e)} AS {n}" for n, e in AGG.items())


@query("j09_aggregate_results", stages(*RES) + f"SELECT dataset, strategy, count(*) AS total_splits, CAST(sum(trades) AS BIGINT) AS total_trades, {AGG_SQL} FROM results GROUP BY 1, 2")
def aggregated(spark, sf_dir):
    return rounded(wf.aggregate_results(materialize(split_table(spark, sf_dir)), GROUPED))


NAMES = ["total_splits", "total_trades", *AGG]


@query("j10_dataset_comparison", stages(
    *RES, "ag AS (SELECT dataset, CAST(count(*) AS DOUBLE) AS total_splits, CAST(sum(trades) AS DOUBLE) AS total_trades, "
    + ", ".join(f"{e} AS {n}" for n, e in AGG.items()) + " FROM results GROUP BY dataset)",
    f"up AS (UNPIVOT ag ON {', '.join(NAMES)} INTO NAME metric VALUE v)")
    + f"SELECT metric, {r(chr(109) + 'ax(v) FILTER (WHERE dataset = ' + chr(39) + 'recent' + chr(39) + ')')} AS recent,"
    f" {r('max(v) FILTER (WHERE dataset = ' + chr(39) + 'historical' + chr(39) + ')')} AS historical FROM up GROUP BY metric")
def comparison(spark, sf_dir):
    return rounded(wf.compare_datasets(wf.aggregate_results(materialize(split_table(spark, sf_dir)), ["dataset"])))


SUMM = {
    "avg_win_rate": "avg(win_rate)", "avg_return": "avg(total_return)", "std_return": "stddev_samp(total_return)",
    "avg_sharpe": "avg(sharpe_ratio)", "avg_max_dd": "avg(max_drawdown)", "max_max_dd": "max(max_drawdown)",
    "positive_pct": "100 * avg(CASE WHEN total_return > 0 THEN 1.0 ELSE 0 END)",
}


@query("j11_result_summary", stages(*RES) + "SELECT dataset, strategy, count(*) AS splits, CAST(sum(trades) AS BIGINT) AS total_trades, "
       + ", ".join(f"{r(e)} AS {n}" for n, e in SUMM.items()) + " FROM results GROUP BY 1, 2")
def result_summary(spark, sf_dir):
    return rounded(wf.summarize_results(split_table(spark, sf_dir), GROUPED))


CRIT = [
    *RES, "su AS (SELECT dataset, strategy, count(*) AS splits, " + ", ".join(f"{e} AS {n}" for n, e in SUMM.items()) + " FROM results GROUP BY 1, 2)",
    "cr AS (" + " UNION ALL ".join(
        f"SELECT dataset, strategy, '{n}' AS criterion, {e} AS passed FROM su" for n, e in (
            ("Minimum 3 walk-forward periods", "splits >= 3"), ("Avg Win Rate > 50%", "avg_win_rate > 0.5"), ("Avg Return > 0%", "avg_return > 0"),
            ("Positive returns in >50% of periods", "positive_pct > 50"), ("Avg Max Drawdown < 15%", "avg_max_dd < 0.15"),
            ("Max Max Drawdown < 20%", "max_max_dd < 0.2"))) + ")",
]


@query("j12_criteria", stages(*CRIT) + "SELECT * FROM cr")
def checks(spark, sf_dir):
    return wf.criteria(wf.summarize_results(split_table(spark, sf_dir), GROUPED), GROUPED)


@query("j12_criteria_verdict", stages(*CRIT) + "SELECT dataset, strategy, count(*) FILTER (WHERE passed) AS passed, count(*) AS checks,"
       " CASE WHEN count(*) FILTER (WHERE passed) = 6 THEN 'PASSED' WHEN count(*) FILTER (WHERE passed) >= 6 * 0.7 THEN 'PROMISING'"
       " ELSE 'NEEDS_WORK' END AS verdict FROM cr GROUP BY 1, 2")
def criteria_verdict(spark, sf_dir):
    return wf.criteria_verdict(wf.criteria(wf.summarize_results(split_table(spark, sf_dir), GROUPED), GROUPED), GROUPED)


@query("j13_overall_stats", stages(*RES) + f"SELECT dataset, strategy, count(*) AS periods, CAST(sum(trades) AS BIGINT) AS total_trades,"
       f" {r('avg(win_rate)')} AS avg_win_rate, {r('avg(sharpe_ratio)')} AS avg_sharpe, {r('stddev_samp(sharpe_ratio)')} AS std_sharpe,"
       " count(*) FILTER (WHERE total_return > 0) AS profitable_periods FROM results GROUP BY 1, 2")
def overall(spark, sf_dir):
    return rounded(wf.overall_stats(split_table(spark, sf_dir), GROUPED))


@query("c11_paired_difference", stages(*RES) + f"""
SELECT a.dataset, a.split_num, {r('a.win_rate - b.win_rate')} AS win_rate_diff, {r('a.total_return - b.total_return')} AS total_return_diff
FROM results a JOIN results b USING (dataset, split_num) WHERE a.strategy = 'A' AND b.strategy = 'R'""")
def paired(spark, sf_dir):
    df = wf.paired_difference(split_table(spark, sf_dir), "A", "R", ["dataset", "split_num"], ["win_rate", "total_return"])
    return rounded(df.where("win_rate_diff IS NOT NULL"))
