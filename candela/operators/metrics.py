"""Performance metrics as grouped aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.functions.keytables import per_key
from candela.functions.durable import materialize
from candela.functions.durable import saved as written
from candela.functions.guards import c, div, div0, pct_change
from candela.functions.series import RN, Series, day_cells, index, numbered, on_series, running

YEAR = math.sqrt(252)


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows per key.  Spark keeps only ``n`` per key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_r", F.row_number().over(w)).where(c("_r") <= n).drop("_r")


def newest_cells(df: DataFrame, keys: list[str], cell: Column, n: int) -> DataFrame:
    """The rows of the newest cells that hold ``n`` rows of each key, or all its rows; ``df`` is read twice.

    ``cell`` is a whole number that rises with the order, null for the oldest rows.
    """
    cell = F.coalesce(cell.cast("long"), F.lit(-(1 << 63)))
    newer = Window.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    needed = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(c("_newer") < n)
    named = [F.col(k).alias(f"_key_{k}") for k in keys]
    first = per_key(needed.groupBy(*keys).agg(F.min("_cell").alias("_first")).select(*named, "_first"))
    same = cell >= c("_first")
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"_key_{k}"))
    return df.join(first, same, "left_semi")


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, win rate, profits, profit factor and expectancy; a loss has pnl of 0 or less."""
    pnl = c("pnl")
    won, lost = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    df = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(pnl > 0).alias("winning_trades"),
        F.count_if(pnl <= 0).alias("losing_trades"),
        F.sum(pnl).alias("total_pnl"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("gross_profit"),
        F.abs(F.coalesce(F.sum(lost), F.lit(0.0))).alias("gross_loss"),
        F.coalesce(F.avg(won), F.lit(0.0)).alias("avg_win"),
        F.abs(F.coalesce(F.avg(lost), F.lit(0.0))).alias("avg_loss"),
    )
    df = df.withColumn("win_rate", div(c("winning_trades"), c("total_trades")))
    return df.withColumns(
        {
            "profit_factor": div0(c("gross_profit"), c("gross_loss")),
            "expectancy": c("win_rate") * c("avg_win") - (1 - c("win_rate")) * c("avg_loss"),
        }
    )


def equity_returns(equity: DataFrame, series: Series) -> DataFrame:
    """Bar-to-bar return and drawdown of an equity curve (columns keys, ts, equity, and positions in ``rn`` if known)."""
    if "rn" in equity.columns:
        equity = numbered(equity, series, "rn")
    df = on_series(
        equity, series, lambda d, f: d.withColumn("ret", pct_change("equity", f.lag("equity"))), 1, keep_helpers=True
    )
    df = running(df, series, {"peak": ("max", c("equity"))})
    return df.withColumn("drawdown", div(c("equity") - c("peak"), "peak"))


def ratio_stats(returns: DataFrame, keys: list[str], risk_free: float = 0.02) -> DataFrame:
    """Sharpe and Sortino ratios; the risk-free rate is taken off every bar."""
    return returns.groupBy(*keys).agg(*_ratios(risk_free))


def _ratios(risk_free: float) -> list[Column]:
    r = c("ret")
    excess = F.avg(r) - risk_free / 252
    down = F.stddev_samp(F.when(r < 0, r))
    return [
        F.coalesce(YEAR * div(excess, F.stddev_samp(r)), F.lit(0.0)).alias("sharpe_ratio"),
        F.coalesce(YEAR * div(excess, down), F.lit(0.0)).alias("sortino_ratio"),
    ]


def _depths() -> list[Column]:
    return [F.abs(F.min("drawdown")).alias("max_drawdown"), F.abs(F.max_by("drawdown", RN)).alias("current_drawdown")]


def longest_runs(df: DataFrame, series: Series, conditions: dict[str, Column], saved: bool = False) -> DataFrame:
    """Longest run of rows that meet each condition, per series.

    The length of the run at a row is its distance from the last row that broke
    it, so a running maximum replaces grouping by islands.  ``df`` carries positions.
    """
    breaks = {f"_b_{n}": ("max", F.when(~F.coalesce(cond, F.lit(False)), c(RN))) for n, cond in conditions.items()}
    df = running(df, series, breaks, saved=saved)
    return df.groupBy(*series.keys).agg(
        *[F.max(c(RN) - F.coalesce(c(f"_b_{n}"), F.lit(0))).alias(n) for n in conditions]
    )


def drawdown_stats(curve: DataFrame, series: Series) -> DataFrame:
    """Worst and latest drawdown and the longest time below the peak, in bars. Needs :func:`equity_returns`."""
    keys = list(series.keys)
    curve = materialize(curve)
    depth = curve.groupBy(*keys).agg(*_depths())
    return depth.join(longest_runs(curve, series, {"max_drawdown_duration_bars": c("drawdown") < 0}, saved=True), keys)


def return_stats(equity: DataFrame, keys: list[str], order: str = "ts") -> DataFrame:
    """Total and yearly return, final equity and number of points."""
    df = equity.groupBy(*keys).agg(
        F.min_by("equity", order).alias("_first"), F.max_by("equity", order).alias("final_equity"),
        F.count(F.lit(1)).alias("points"),
    )
    df = df.withColumn("total_return", pct_change("final_equity", "_first")).drop("_first")
    return df.withColumn("annual_return", c("total_return") * (F.lit(252.0) / c("points")))


def duration_hours(entry: str = "entry_time", exit_: str = "exit_time") -> Column:
    return F.timestamp_diff("SECOND", c(entry), c(exit_)) / 3600.0


def streaks(trades: DataFrame, series: Series) -> DataFrame:
    """Longest winning and losing streaks in the order of the series."""
    df = index(trades.select(*series.keys, *series.order, "pnl"), series)
    return longest_runs(
        df, series, {"max_consecutive_wins": c("pnl") > 0, "max_consecutive_losses": c("pnl") <= 0}
    )


METRICS = (
    "total_trades", "winning_trades", "losing_trades", "win_rate", "total_pnl", "total_return_pct",
    "annual_return_pct", "gross_profit", "gross_loss", "avg_win", "avg_loss", "profit_factor", "expectancy",
    "sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown_pct", "current_drawdown_pct",
    "max_drawdown_duration_days", "avg_trade_duration_hours", "max_consecutive_wins", "max_consecutive_losses",
    "avg_mae", "avg_mfe", "recovery_factor", "final_equity",
)


def backtest_metrics(
    trades: DataFrame, equity: DataFrame, series: Series, initial_capital: float = 10000.0, risk_free: float = 0.02
) -> DataFrame:
    """The 26 metrics per key; keys without trades get zeros."""
    keys = list(series.keys)
    curve = materialize(equity_returns(equity, series))
    by_exit = Series(series.keys, ("exit_time", "entry_time"), day_cells("exit_time", 30), series.chunk_rows)
    extra = trades.groupBy(*keys).agg(
        F.avg(duration_hours()).alias("avg_trade_duration_hours"),
        F.avg("max_adverse_excursion").alias("avg_mae"),
        F.avg("max_favorable_excursion").alias("avg_mfe"),
    )
    whole = curve.groupBy(*keys).agg(
        *_ratios(risk_free), *_depths(), F.min_by("equity", RN).alias("_first"), F.max_by("equity", RN).alias("final_equity"),
        F.count(F.lit(1)).alias("points"),
    )
    whole = whole.withColumn("total_return", pct_change("final_equity", "_first"))
    whole = whole.withColumn("annual_return", c("total_return") * (F.lit(252.0) / c("points")))
    df = trade_stats(trades, keys)
    for part in (
        extra, streaks(trades, by_exit), whole,
        longest_runs(curve, series, {"max_drawdown_duration_bars": c("drawdown") < 0}, saved=True),
    ):
        df = df.join(part, keys)
    worst = c("max_drawdown")
    df = df.select(
        *keys,
        "*",
        (c("total_return") * 100).alias("total_return_pct"),
        (c("annual_return") * 100).alias("annual_return_pct"),
        (worst * 100).alias("max_drawdown_pct"),
        (c("current_drawdown") * 100).alias("current_drawdown_pct"),
        c("max_drawdown_duration_bars").alias("max_drawdown_duration_days"),
        div0(c("total_return"), worst).alias("calmar_ratio"),
        div0(c("total_pnl"), worst * initial_capital).alias("recovery_factor"),
    ).select(*[df[k] for k in keys], *METRICS)
    return zero_filled(curve.select(*keys).distinct(), df, keys)


def zero_filled(all_keys: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics for every key; all zero where a key has no trades."""
    return all_keys.join(metrics, keys, "left").fillna(0, [n for n in metrics.columns if n not in keys])


# ---- dashboard figures ---------------------------------------------------------------


def dashboard_metrics(trades: DataFrame, series: Series, saved: bool = False) -> DataFrame:
    """The dashboard's variant: rates in percent, Sharpe on pnl_percent with population deviation, drawdown in currency.

    ``trades`` is read twice, so it is saved first unless the caller says it already is.  Without entry_time there is no duration.
    """
    keys = list(series.keys)
    pnl = c("pnl")
    won, lost = F.when(pnl > 0, pnl), F.when(pnl <= 0, pnl)
    entry = ["entry_time"] if "entry_time" in trades.columns else []
    need = dict.fromkeys([*keys, *series.order, *entry, "exit_time", "pnl", "pnl_percent"])
    slim = trades.select(*need)
    slim = slim if saved else written(slim, "dashboard-trades")
    df = slim.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(pnl > 0).alias("winning_trades"),
        F.count_if(pnl <= 0).alias("losing_trades"),
        F.sum(pnl).alias("total_pnl"),
        F.coalesce(F.avg(won), F.lit(0.0)).alias("avg_win"),
        F.abs(F.coalesce(F.avg(lost), F.lit(0.0))).alias("avg_loss"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("_gain"),
        F.abs(F.coalesce(F.sum(lost), F.lit(0.0))).alias("_loss"),
        (div0(F.avg("pnl_percent"), F.stddev_pop("pnl_percent")) * YEAR).alias("sharpe_ratio"),
        *[F.avg(duration_hours()).alias("avg_trade_duration") for _ in entry],
    )
    depth = pnl_path(slim, series).select(
        *keys, F.abs("drawdown").alias("max_drawdown"), F.abs(c("cumulative") - c("peak")).alias("current_drawdown")
    )
    df = df.join(depth, keys).withColumn("win_rate", 100 * div(c("winning_trades"), c("total_trades")))
    return df.withColumns(
        {
            "profit_factor": div0(c("_gain"), c("_loss")),
            "expectancy": c("win_rate") / 100 * c("avg_win") - (100 - c("win_rate")) / 100 * c("avg_loss"),
        }
    ).drop("_gain", "_loss")


def cumulative_pnl(trades: DataFrame, series: Series) -> DataFrame:
    """Trades in order with cumulative pnl, its peak and the drawdown in currency (helper columns kept)."""
    df = running(index(trades, series), series, {"cumulative": ("sum", c("pnl"))})
    df = running(df, series, {"peak": ("max", c("cumulative"))})
    return df.withColumn("drawdown", c("cumulative") - c("peak"))


def pnl_path(trades: DataFrame, series: Series) -> DataFrame:
    """How the pnl of a series adds up trade by trade, one row per series: ``rows``, the ``cumulative`` pnl at the end, its
    ``peak``, its ``low``, the deepest ``drawdown`` below the peak so far, and the position of the ``last_win``.

    Every cell is walked on its own.  What comes before a cell only shifts its sums, so the cells are then laid end to
    end, level by level: trades are shuffled once, and go on as one row per cell.
    """
    keys, cells = list(series.keys), series.cell()
    names = [f"_cell{i}" for i in range(len(cells))]
    here = Window.partitionBy(*keys, *names).orderBy(*series.order).rowsBetween(Window.unboundedPreceding, 0)
    df = trades.select(*dict.fromkeys([*keys, *series.order, "pnl"])).withColumns(dict(zip(names, cells)))
    df = df.withColumns({"_sum": F.sum("pnl").over(here), RN: F.row_number().over(here)})
    df = df.withColumn("_top", F.max("_sum").over(here))
    parts = df.groupBy(*keys, *names).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max_by("_sum", RN).alias("cumulative"),
        F.max("_sum").alias("peak"),
        F.min("_sum").alias("low"),
        F.min(c("_sum") - c("_top")).alias("drawdown"),
        F.max(F.when(c("pnl") > 0, c(RN))).alias("last_win"),
    )
    for depth in range(len(names) - 1, -1, -1):
        level, place = [*keys, *names[:depth]], names[depth]
        before = Window.partitionBy(*level).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0)
        parts = parts.withColumns(
            {"_rows": F.coalesce(F.sum("rows").over(before), zero), "_sum": F.coalesce(F.sum("cumulative").over(before), zero)}
        ).withColumn("_top", F.max(c("_sum") + c("peak")).over(before))
        parts = parts.groupBy(*level).agg(
            F.sum("rows").alias("rows"),
            F.max_by(c("_sum") + c("cumulative"), F.when(c("cumulative").isNotNull(), c(place))).alias("cumulative"),
            F.max(c("_sum") + c("peak")).alias("peak"),
            F.min(c("_sum") + c("low")).alias("low"),
            F.min(F.least(c("drawdown"), c("_sum") + c("low") - c("_top"))).alias("drawdown"),
            F.max(c("_rows") + c("last_win")).alias("last_win"),
        )
    return parts


def daily_pnl(trades: DataFrame, keys: list[str]) -> DataFrame:
    return trades.groupBy(*keys, F.to_date("exit_time").alias("day")).agg(
        F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades")
    )


def rolling_win_rate(trades: DataFrame, series: Series, window=20, need=10) -> DataFrame:
    won = lambda df, f: df.withColumn("_w", (c("pnl") > 0).cast("double"))
    return on_series(
        trades,
        series,
        lambda df, f: won(df, f).withColumn("rolling_win_rate", 100 * f.at_least("_w", window, need)).drop("_w"),
        window,
    )


def pnl_histogram(trades: DataFrame, keys: list[str], bins: int = 30) -> DataFrame:
    """Counts in equal bins between the smallest and largest pnl of each key; the top edge belongs to the last bin."""
    edges = per_key(trades.groupBy(*keys).agg(F.min("pnl").alias("_lo"), F.max("pnl").alias("_hi")))
    df = trades.join(edges, keys)
    width = (c("_hi") - c("_lo")) / bins
    bucket = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(c("pnl") - c("_lo"), width)), F.lit(0)))
    return df.groupBy(*keys, bucket.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("trades"), F.first(c("_lo")).alias("_lo"), F.first(width).alias("_w")
    ).select(*keys, "bin", (c("_lo") + c("bin") * c("_w")).alias("bin_start"), "trades")


def exposure(positions: DataFrame, key: str = "instrument") -> DataFrame:
    return positions.groupBy(key).agg(F.sum(c("size") * c("entry_price")).alias("exposure"))


def by_group(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Sum, mean and count of pnl and mean pnl_percent per group."""
    return trades.groupBy(*keys).agg(
        F.sum("pnl").alias("pnl_sum"), F.avg("pnl").alias("pnl_mean"), F.count(F.lit(1)).alias("trades"),
        F.avg("pnl_percent").alias("pnl_percent_mean"),
    )


def by_hour(trades: DataFrame, ts: str = "exit_time") -> DataFrame:
    return trades.groupBy(F.hour(ts).alias("hour")).agg(F.sum("pnl").alias("pnl_sum"), F.count(F.lit(1)).alias("trades"))


WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def weekday_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(WEEKDAYS)), "day_number int, weekday string")


def by_weekday(trades: DataFrame, ts: str = "exit_time") -> DataFrame:
    """Per weekday in calendar order; days without trades stay with nulls."""
    stats = trades.groupBy(F.weekday(ts).alias("day_number")).agg(
        F.sum("pnl").alias("pnl_sum"), F.count(F.lit(1)).alias("trades"), F.avg("pnl").alias("pnl_mean")
    )
    return weekday_frame(trades.sparkSession).join(stats, "day_number", "left")


def recent_stats(trades: DataFrame, keys: list[str], order: list[str], n: int = 10) -> DataFrame:
    """Wins, losses, win rate and pnl of the newest ``n`` trades."""
    return last_rows(trades, keys, order, n).groupBy(*keys).agg(
        F.count_if(c("pnl") > 0).alias("wins"),
        F.count_if(c("pnl") <= 0).alias("losses"),
        (100 * F.avg((c("pnl") > 0).cast("double"))).alias("win_rate"),
        F.sum("pnl").alias("pnl_sum"),
        F.avg("pnl").alias("pnl_mean"),
    )


def limit_usage(
    metrics: DataFrame, daily: Column, drawdown: Column, equity: Column, max_daily_loss=0.05, max_drawdown=0.15
) -> DataFrame:
    """Share of the daily-loss and drawdown limits in use, at most 1."""
    one = F.lit(1.0)
    return metrics.withColumns(
        {
            "daily_loss_used": F.least(one, F.abs(div(daily, equity)) / max_daily_loss),
            "drawdown_used": F.least(one, div(drawdown, equity) / max_drawdown),
        }
    )


def recent_pnl(trades: DataFrame, keys: list[str], as_of: str, hours: int = 24) -> DataFrame:
    """Pnl of the trades closed in the ``hours`` before ``as_of``."""
    end = F.lit(as_of).cast("timestamp_ntz")
    inside = (c("exit_time") > end - F.expr(f"INTERVAL {hours} HOURS")) & (c("exit_time") <= end)
    return trades.groupBy(*keys).agg(F.coalesce(F.sum(F.when(inside, c("pnl"))), F.lit(0.0)).alias("recent_pnl"))


def monthly_excess(trades: DataFrame, bars: DataFrame, keys: list[str], capital: float = 10000.0) -> DataFrame:
    """Strategy return per month against buy and hold of the same month."""
    month = lambda ts: F.date_format(ts, "yyyy-MM")
    earned = trades.groupBy(*keys, month("exit_time").alias("month")).agg(
        F.count(F.lit(1)).alias("trades"), (100 * F.sum("pnl") / capital).alias("strategy_return_pct")
    )
    held = bars.groupBy(*keys, month("ts").alias("month")).agg(
        (100 * pct_change(F.max_by("close", "ts"), F.min_by("close", "ts"))).alias("buy_hold_pct")
    )
    df = held.join(earned, [*keys, "month"], "left").fillna({"trades": 0, "strategy_return_pct": 0.0})
    return df.withColumn("excess_pct", c("strategy_return_pct") - c("buy_hold_pct"))
