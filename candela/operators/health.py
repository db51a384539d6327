"""Risk alerts, trade health, recovery plans."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.guards import c, div, div0
from candela.functions.series import Series
from candela.operators.metrics import last_rows, newest_cells, pnl_path


def alerts_from(df: DataFrame, keys: list[str], rules: list[tuple[Column, str, str, Column]]) -> DataFrame:
    """One row per rule that holds: level, category, message."""
    made = [
        F.when(
            cond, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), text.alias("message"))
        )
        for cond, level, category, text in rules
    ]
    return df.select(*keys, F.inline(F.filter(F.array(*made), lambda a: a.isNotNull())))


def risk_alerts(
    metrics: DataFrame, keys: list[str], daily: Column, capital: Column, max_daily_loss=0.05, max_drawdown=0.15
) -> DataFrame:
    """Daily loss, drawdown, win-rate (percent) and Sharpe alerts from a dashboard metrics table."""
    loss, fall = daily / capital, c("current_drawdown") / capital
    pct = lambda x: F.format_string("%.2f%%", x * 100)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return alerts_from(
        metrics,
        keys,
        [
            (loss < -max_daily_loss, "critical", "Risk Limit",
             say("Daily loss limit exceeded: ", pct(loss), f" (Limit: {-max_daily_loss:.2%})")),
            ((loss < -max_daily_loss * 0.7) & (loss >= -max_daily_loss), "warning", "Risk Warning",
             say("Approaching daily loss limit: ", pct(loss))),
            (fall > max_drawdown, "critical", "Risk Limit",
             say("Maximum drawdown exceeded: ", pct(fall), f" (Limit: {max_drawdown:.2%})")),
            ((fall > max_drawdown * 0.8) & (fall <= max_drawdown), "warning", "Risk Warning",
             say("Approaching max drawdown: ", pct(fall))),
            ((c("total_trades") >= 5) & (c("win_rate") < 30), "warning", "Performance",
             say("Low win rate detected: ", F.format_string("%.1f%%", c("win_rate")))),
            ((c("total_trades") >= 20) & (c("sharpe_ratio") < 0), "warning", "Performance",
             say("Negative Sharpe ratio: ", F.format_string("%.2f", c("sharpe_ratio")))),
        ],
    )


@dataclass(frozen=True)
class HealthLimits:
    min_win_rate: float = 0.45
    min_sharpe: float = 0.5
    max_consecutive_losses: int = 5
    max_drawdown: float = 0.15
    min_confidence: float = 0.55


def recent_win_rates(
    trades: DataFrame, keys: list[str], order: list[str], windows=(30, 100), cell: Column | None = None
) -> DataFrame:
    """Win rate over the last n trades (or all, if fewer).

    ``cell``, if given, rises with the order: only rows of the newest cells are then sorted, and ``trades`` is read twice.
    """
    from pyspark.sql import Window

    if cell is not None:
        trades = newest_cells(trades, keys, cell, max(windows))
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    ranked = trades.withColumn("_r", F.row_number().over(w)).where(c("_r") <= max(windows))
    won = (c("pnl") > 0).cast("double")
    return ranked.groupBy(*keys).agg(
        *[F.coalesce(F.avg(F.when(c("_r") <= n, won)), F.lit(0.0)).alias(f"win_rate_{n}") for n in windows]
    )


def trade_state(trades: DataFrame, series: Series, as_of: str, days: int = 30) -> DataFrame:
    """Trade count, 30-day Sharpe, drawdown from the pnl peak and current losing streak, as of a time.  ``trades`` is read twice."""
    keys = list(series.keys)
    end = F.lit(as_of).cast("timestamp_ntz")
    slim = trades.where(c("exit_time") <= end).select(*keys, *series.order, "pnl", "pnl_percent")
    fresh = F.when(c("exit_time") >= end - F.expr(f"INTERVAL {days} DAYS"), c("pnl_percent"))
    df = slim.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count(fresh).alias("_n"),
        (div0(F.avg(fresh), F.stddev_pop(fresh)) * math.sqrt(252)).alias("_sharpe"),
    )
    df = df.join(pnl_path(slim, series), keys)
    enough = (c("trades") >= 20) & (c("_n") >= 10)
    return df.select(
        *keys,
        "trades",
        F.when(enough, c("_sharpe")).otherwise(0.0).alias("sharpe_30d"),
        F.abs(div(c("cumulative") - c("peak"), F.abs("peak"))).alias("current_drawdown"),
        (c("rows") - F.coalesce(c("last_win"), F.lit(0))).alias("consecutive_losses"),
    )


def prediction_confidence(predictions: DataFrame, keys: list[str], order: list[str], n: int = 20) -> DataFrame:
    return last_rows(predictions, keys, order, n).groupBy(*keys).agg(F.avg("confidence").alias("prediction_confidence"))


def baseline_from_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline row of a back-test's metrics."""
    return metrics.select(
        *keys,
        c("win_rate").alias("baseline_win_rate"),
        c("sharpe_ratio").alias("baseline_sharpe"),
        c("profit_factor").alias("baseline_profit_factor"),
    )


def drift_score() -> Column:
    base = c("baseline_win_rate")
    off = lambda n: div(F.abs(c(n) - base), base)
    score = F.least(0.7 * off("win_rate_30") + 0.3 * off("win_rate_100"), F.lit(1.0))
    return F.when((c("trades") >= 50) & base.isNotNull(), F.coalesce(score, F.lit(0.0))).otherwise(0.0)


def breakdown_score() -> Column:
    wr, sh = c("baseline_win_rate"), c("baseline_sharpe")
    gap = F.abs(c("win_rate_30") - wr) + F.abs(c("sharpe_30d") - sh) / F.greatest(F.abs(sh), F.lit(1.0))
    known = (c("trades") >= 30) & (wr != 0) & (sh != 0)
    return F.when(known, F.least(gap / 2, F.lit(1.0))).otherwise(0.0)


def health_status(df: DataFrame, limits: HealthLimits = HealthLimits()) -> DataFrame:
    """Status, recommended action and warnings from the health columns."""
    wr, sh, fall = c("win_rate_30"), c("sharpe_30d"), F.coalesce(c("current_drawdown"), F.lit(0.0))
    lost, conf, drift, broken = (
        c("consecutive_losses"), c("prediction_confidence"), c("model_drift_score"), c("correlation_breakdown")
    )
    failed = (lost >= limits.max_consecutive_losses) | (fall > limits.max_drawdown) | (wr < 0.3)
    critical = (sh < -0.5) | (wr < 0.35) | (drift > 0.5)
    warning = (
        (sh < limits.min_sharpe) | (wr < limits.min_win_rate) | (lost >= 3) | (drift > 0.3)
        | (conf < limits.min_confidence)
    )
    pct = lambda x: F.format_string("%.1f%%", x * 100)
    num = lambda x: F.format_string("%.2f", x)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    notes = [
        (wr < limits.min_win_rate, say("Win rate dropped to ", pct(wr), f" (threshold: {limits.min_win_rate:.1%})")),
        (sh < limits.min_sharpe, say("Sharpe ratio at ", num(sh), f" (threshold: {limits.min_sharpe:.2f})")),
        (lost >= limits.max_consecutive_losses,
         say("Consecutive losses: ", lost.cast("string"), f" (threshold: {limits.max_consecutive_losses})")),
        (fall > limits.max_drawdown, say("Drawdown at ", pct(fall), f" (threshold: {limits.max_drawdown:.1%})")),
        ((conf > 0) & (conf < limits.min_confidence), say("Model confidence dropped to ", pct(conf))),
        (drift > 0.3, say("Model drift detected: ", num(drift))),
        (broken > 0.5, say("Correlation breakdown: ", num(broken))),
    ]
    return df.withColumns(
        {
            "status": F.when(failed, "failed").when(critical, "critical").when(warning, "warning").otherwise("healthy"),
            "recommended_action": F.when(failed, "stop_trading").when(critical, "close_positions")
            .when(warning, "reduce_size").otherwise("continue"),
            "warnings": F.filter(F.array(*[F.when(cond, text) for cond, text in notes]), lambda t: t.isNotNull()),
        }
    )


def check_health(
    trades: DataFrame,
    series: Series,
    as_of: str,
    baseline: DataFrame | None = None,
    confidence: DataFrame | None = None,
    limits: HealthLimits = HealthLimits(),
) -> DataFrame:
    """One health row per key: win rates, Sharpe, drawdown, streak, drift, breakdown, status and warnings.

    ``trades`` is read four times and should be saved, unless it is a plain scan.
    """
    keys = list(series.keys)
    past = trades.where(c("exit_time") <= F.lit(as_of).cast("timestamp_ntz"))
    recent = recent_win_rates(past, keys, list(series.order), cell=series.cell()[0])
    df = trade_state(trades, series, as_of).join(recent, keys)
    if baseline is not None:
        df = df.join(baseline, keys, "left")
    else:
        df = df.withColumns({n: F.lit(None).cast("double") for n in ("baseline_win_rate", "baseline_sharpe")})
    if confidence is not None:
        df = df.join(confidence, keys, "left").fillna(0.0, ["prediction_confidence"])
    else:
        df = df.withColumn("prediction_confidence", F.lit(0.0))
    df = df.withColumns({"model_drift_score": drift_score(), "correlation_breakdown": breakdown_score()})
    return health_status(df, limits)


def recovery_plan(health: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """What each action asks for: size multiplier, pause, positions to close, restoring. Nothing is executed."""
    counts = positions.groupBy(*keys).agg(F.count(F.lit(1)).alias("open_positions"))
    action = c("recommended_action")
    close = action.isin("stop_trading", "close_positions")
    held = F.coalesce(c("open_positions"), F.lit(0))
    return health.join(counts, keys, "left").select(
        *keys,
        "status",
        "recommended_action",
        F.when(action == "reduce_size", F.when(c("status") == "warning", 0.5).otherwise(0.25))
        .when(close, 0.0).otherwise(1.0).alias("size_multiplier"),
        action.isin("stop_trading", "close_positions", "pause_new_trades").alias("pause_trading"),
        F.when(close, held).otherwise(F.lit(0).cast("bigint")).alias("positions_to_close"),
        ((action == "continue") & (c("win_rate_30") > 0.52) & (c("sharpe_30d") > 1.0)).alias("restore_size"),
    )
