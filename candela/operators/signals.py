"""Trading rules as columns.

A rule adds ``action`` (buy, sell, close or null), ``stop_loss``, ``take_profit``
and ``reason`` to each bar, and ``exit_long`` / ``exit_short`` flags for the
bars where the rule would leave a position.  Nothing is computed per row in
Python; a rule of one's own is any function from bars to such columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.guards import c, flag, pct_change
from candela.functions.series import RN, Frame, Series, bar_series, on_series
from candela.operators.indicators import (
    Indicator, atr, beside, bollinger, chain, close_std, indicator, momentum_80_20, price_channel, rsi, sma,
)

SIGNAL_COLUMNS = ("action", "stop_loss", "take_profit", "reason", "exit_long", "exit_short")


def entry_columns(
    buy: Column, sell: Column, price: Column, stop: Column, target: Column | None,
    buy_reason, sell_reason, fixed_target: Column | None = None, prefix: str = "",
) -> dict[str, Column]:
    """Entry columns from two conditions and the stop and target distances; buy wins over sell."""
    buy, sell = F.coalesce(buy, F.lit(False)), F.coalesce(sell, F.lit(False))
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    up = fixed_target if fixed_target is not None else price + target
    down = fixed_target if fixed_target is not None else price - target
    return {
        f"{prefix}action": F.when(buy, "buy").when(sell, "sell"),
        f"{prefix}stop_loss": F.when(buy, price - stop).when(sell, price + stop),
        f"{prefix}take_profit": F.when(buy, up).when(sell, down),
        f"{prefix}reason": F.when(buy, text(buy_reason)).when(sell, text(sell_reason)),
    }


@dataclass(frozen=True)
class Rule:
    """A named rule: indicator levels that end in the signal columns (with ``prefix`` in front of each)."""

    name: str
    build: Callable[[str], Indicator]

    def __call__(self, bars: DataFrame, series: Series | None = None, keep_helpers: bool = False) -> DataFrame:
        part = self.build("")
        return on_series(bars, series or bar_series(), part.stage, part.lookback, keep_helpers=keep_helpers, means=part.means)


def entries(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("action").isin("buy", "sell"))


# ---- rules on prices -------------------------------------------------------------


def crossover_levels(fast: int, slow: int, rsi_period: int = 14, min_rows: int = 0) -> Callable[[str], Indicator]:
    def build(prefix: str) -> Indicator:
        def final(f: Frame) -> dict[str, Column]:
            a, b, strength = c(f"sma_{fast}"), c(f"sma_{slow}"), c(f"rsi_{rsi_period}")
            pa, pb = f.lag(f"sma_{fast}"), f.lag(f"sma_{slow}")
            ready = c(RN) >= max(slow + 1, min_rows)
            sd = c("close_std_14")
            return {
                **entry_columns(
                    ready & (pa <= pb) & (a > b) & (strength < 70), ready & (pa >= pb) & (a < b) & (strength > 30),
                    c("close"), 2 * sd, 3 * sd, "bullish_crossover", "bearish_crossover", prefix=prefix,
                ),
                f"{prefix}exit_long": flag(ready & (a < b)),
                f"{prefix}exit_short": flag(ready & (a > b)),
            }

        return chain(beside(sma((fast, slow)), rsi(rsi_period), close_std(14)), indicator(1, final))

    return build


def momentum_rule(fast=20, slow=50, rsi_period=14) -> Rule:
    """Average crossing with a strength filter; stop 2x and target 3x the 14-bar deviation of closes."""
    return Rule(f"Momentum_{fast}_{slow}", crossover_levels(fast, slow, rsi_period))


def mean_reversion_rule(period=20, width=2.0, rsi_period=14) -> Rule:
    """Band touch with a strength filter; target is the middle band."""
    def build(prefix):
        def final(f):
            k, r = c("close"), c(f"rsi_{rsi_period}")
            mid, up, low = (c(f"bb_{n}_{period}") for n in ("middle", "upper", "lower"))
            ready = c(RN) >= period + 1
            return {
                **entry_columns(
                    ready & (k <= low) & (r < 30), ready & (k >= up) & (r > 70), k, 1.5 * c("close_std_14"), None,
                    "oversold_mean_reversion", "overbought_mean_reversion", fixed_target=mid, prefix=prefix,
                ),
                f"{prefix}exit_long": flag(ready & (k >= mid)),
                f"{prefix}exit_short": flag(ready & (k <= mid)),
            }

        return chain(beside(bollinger(period, width), rsi(rsi_period), close_std(14)), indicator(0, final))

    return Rule("MeanReversion", build)


def breakout_rule(lookback=20, atr_period=14) -> Rule:
    """Close beyond the channel of the bars before; stop 2x and target 3x the mean range. It never exits by itself."""
    def build(prefix):
        def final(f):
            k, reach = c("close"), c(f"atr_{atr_period}")
            ready = c(RN) >= lookback + 1
            return {
                **entry_columns(
                    ready & (k > c(f"channel_high_{lookback}")), ready & (k < c(f"channel_low_{lookback}")),
                    k, 2 * reach, 3 * reach, "bullish_breakout", "bearish_breakout", prefix=prefix,
                ),
                f"{prefix}exit_long": F.lit(0),
                f"{prefix}exit_short": F.lit(0),
            }

        return chain(beside(price_channel(lookback), atr(atr_period)), indicator(0, final))

    return Rule("Breakout", build)


# Return deviation that separates calm from wild, and the average pairs for each.
WILD_DEVIATION, WILD_PAIR, CALM_PAIR, ADAPTIVE_MIN_ROWS = 0.002, (10, 30), (30, 70), 100


def adaptive_momentum_rule() -> Rule:
    """Momentum rule whose averages depend on the recent deviation of returns."""
    def build(prefix):
        wild = crossover_levels(*WILD_PAIR, min_rows=ADAPTIVE_MIN_ROWS)("_wild_")
        calm = crossover_levels(*CALM_PAIR, min_rows=ADAPTIVE_MIN_ROWS)("_calm_")
        deviation = chain(
            indicator(1, lambda f: {"_am_ret": pct_change("close", f.lag("close"))}),
            indicator(20, lambda f: {"_am_dev": f.full("_am_ret", 20, F.stddev_samp)}),
        )

        def choose(f):
            is_wild = F.coalesce(c("_am_dev") > WILD_DEVIATION, F.lit(False))
            return {
                f"{prefix}{n}": F.when(is_wild, c(f"_wild_{n}")).otherwise(c(f"_calm_{n}")) for n in SIGNAL_COLUMNS
            }

        return chain(beside(wild, calm, deviation), indicator(0, choose))

    return Rule("Adaptive_Momentum", build)


def momentum_80_20_rule(short=10, long=20, roc=10, threshold=0.5, atr_period=14, stop=2.0, target=3.0) -> Rule:
    """Rate of change agreeing with the trend, both ways; three exit reasons in fixed priority."""
    def build(prefix):
        def final(f):
            s, l, m, reach = c("sma_short"), c("sma_long"), c("roc"), c("atr")
            ready = (c(RN) >= max(long, roc, atr_period) + 1) & s.isNotNull() & reach.isNotNull()
            above = F.coalesce(s > l, F.lit(False))
            crossed = F.coalesce((s < l) & (f.lag("sma_short") >= f.lag("sma_long")), F.lit(False))
            reversed_ = F.coalesce(m < -threshold, F.lit(False))
            turned = F.coalesce(c("trend_strength") < -0.5, F.lit(False))
            leave = flag(ready & (crossed | reversed_ | turned))
            why = F.when(ready & crossed, "SMA_Crossover").when(ready & reversed_, "Momentum_Reversal").when(
                ready & turned, "Trend_Reversal"
            )
            return {
                **entry_columns(
                    ready & (m > threshold) & above, ready & (m < -threshold) & ~above, c("close"),
                    stop * reach, target * reach, F.format_string("Bullish_Momentum_ROC=%.2f%%", m),
                    F.format_string("Bearish_Momentum_ROC=%.2f%%", m), prefix=prefix,
                ),
                f"{prefix}exit_long": leave,
                f"{prefix}exit_short": leave,
                f"{prefix}exit_reason": why,
            }

        return chain(momentum_80_20(short, long, roc, atr_period), indicator(1, final))

    return Rule("Momentum_80_20", build)


def vote_rule(rules: list[Rule], method: str = "majority") -> Rule:
    """Buy or sell where more than half (or all) rules agree; stop and target are the voters' means.

    All rules run side by side over one windowing, so a vote needs no join.
    """
    def build(prefix):
        tags = [f"_v{i}_" for i in range(len(rules))]
        total = len(rules)

        def final(f):
            votes = {a: sum((flag(c(f"{t}action") == a) for t in tags), F.lit(0)) for a in ("buy", "sell", "close")}
            wins = {a: (v == total) if method == "unanimous" else (v > total / 2) for a, v in votes.items()}

            def mean(column, action):
                parts = [F.when(c(f"{t}action") == action, c(f"{t}{column}")) for t in tags]
                return sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / F.nullif(
                    sum((flag(p.isNotNull()) for p in parts), F.lit(0)), F.lit(0)
                )

            def reason(action):
                if method == "unanimous":
                    return F.lit(f"ensemble_unanimous_{action}")
                return F.concat(F.lit(f"ensemble_{action}_"), votes[action].cast("string"), F.lit(f"/{total}"))

            order = ["buy", "sell"] + ([] if method == "unanimous" else ["close"])
            pick = lambda g, names=order: _ladder([(wins[a], g(a)) for a in names])
            return {
                f"{prefix}action": pick(lambda a: F.lit(a)),
                f"{prefix}stop_loss": pick(lambda a: mean("stop_loss", a), ["buy", "sell"]),
                f"{prefix}take_profit": pick(lambda a: mean("take_profit", a), ["buy", "sell"]),
                f"{prefix}reason": pick(reason),
                f"{prefix}exit_long": F.lit(0),
                f"{prefix}exit_short": F.lit(0),
            }

        return chain(beside(*[r.build(t) for r, t in zip(rules, tags)]), indicator(0, final))

    return Rule(f"Ensemble_{method}", build)


def _ladder(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out


# ---- rules on model scores ---------------------------------------------------------


def model_rule(
    scored: DataFrame, threshold=0.6, regime_adaptive=True, both_sides=True, distance="close_std_14",
    min_rows: int = 200,
) -> DataFrame:
    """Signals from ``prob_up``: trade when the probability of the predicted class reaches the threshold.

    With ``regime_adaptive`` the columns ``confidence_threshold``,
    ``stop_loss_atr_mult`` and ``take_profit_atr_mult`` of the regime replace
    the fixed settings.
    """
    p = c("prob_up")
    up = p > 0.5
    confidence = F.greatest(p, 1 - p)
    need = c("confidence_threshold") if regime_adaptive else F.lit(threshold)
    stop = c("stop_loss_atr_mult") if regime_adaptive else F.lit(2.0)
    target = c("take_profit_atr_mult") if regime_adaptive else F.lit(3.0)
    ready = (c("rn") >= min_rows) & (confidence >= need)
    reach = c(distance)
    return scored.withColumns(
        {
            **entry_columns(
                ready & up, ready & ~up if both_sides else F.lit(False), c("close"), stop * reach, target * reach,
                F.format_string("ml_buy_confidence_%.2f", confidence),
                F.format_string("ml_sell_confidence_%.2f", confidence),
            ),
            "confidence": confidence,
            "exit_long": flag((c("rn") >= min_rows) & ~up),
            "exit_short": flag((c("rn") >= min_rows) & up),
        }
    )


def long_only_model_rule(scored: DataFrame, threshold=0.6, min_rows: int = 60) -> DataFrame:
    """Buy when up is predicted with enough confidence; stop 2x and target 3x the mean range; leave on down."""
    p = c("prob_up")
    up, confidence = p > 0.5, F.greatest(p, 1 - p)
    ready = (c("rn") >= min_rows) & c("atr_14").isNotNull()
    return scored.withColumns(
        {
            **entry_columns(
                ready & up & (confidence >= threshold), F.lit(False), c("close"), 2 * c("atr_14"), 3 * c("atr_14"),
                F.format_string("ML_BUY_conf=%.2f", confidence), "",
            ),
            "confidence": confidence,
            "exit_long": flag(ready & ~up),
            "exit_short": F.lit(0),
        }
    )


def agreement_rule(
    scored: DataFrame, probabilities: list[str], threshold=0.6, agreement=3, min_rows=60, label="MTF"
) -> DataFrame:
    """Buy when enough models are confidently up; leave when enough are confidently down."""
    ps = [c(n) for n in probabilities]
    n = len(ps)
    ups = sum((flag((p > 0.5) & (p >= threshold)) for p in ps), F.lit(0))
    downs = sum((flag((p <= 0.5) & (1 - p >= threshold)) for p in ps), F.lit(0))
    up_sum = sum((F.when(p > 0.5, p).otherwise(0.0) for p in ps), F.lit(0.0))
    up_n = sum((flag(p > 0.5) for p in ps), F.lit(0))
    mean_up = F.try_divide(up_sum, up_n)
    ready = (c("rn") >= min_rows) & c("atr_14").isNotNull()
    return scored.withColumns(
        {
            **entry_columns(
                ready & (ups >= agreement), F.lit(False), c("close"), 2 * c("atr_14"), 3 * c("atr_14"),
                F.concat(F.lit(f"{label}_BUY_"), ups.cast("string"), F.lit(f"/{n}_conf="), F.format_string("%.2f", mean_up)),
                "",
            ),
            "up_votes": ups,
            "down_votes": downs,
            "confidence": mean_up,
            "exit_long": flag(ready & (downs >= agreement)),
            "exit_short": F.lit(0),
        }
    )


def regime_model_rule(
    scored: DataFrame, probability: str = "prob_up", balanced_probability: str | None = None, min_rows=200
) -> DataFrame:
    """Model signals under range regimes: adjusted threshold, regime distances, size multiplier, exit levels.

    Needs the columns of ``with_adaptive_settings``.  With a second probability
    the regime also decides which model speaks.
    """
    p = c(probability)
    who = F.lit("ML")
    if balanced_probability:
        p = F.when(c("use_balanced"), c(balanced_probability)).otherwise(p)
        who = F.when(c("use_balanced"), "Balanced").otherwise("Original")
    up, confidence = p > 0.5, F.greatest(p, 1 - p)
    ready = (c("rn") >= min_rows) & ~c("skip_trading") & (confidence >= c("confidence_threshold"))
    reach = c("atr_14")
    text = lambda side: F.concat_ws("_", "regime_name", who, F.lit(side), F.format_string("%.2f", confidence))
    leave_at = F.when(c("regime_name").isin("VOLATILE", "BEAR"), 0.50).otherwise(0.55)
    leave = flag(ready & (confidence >= leave_at))
    return scored.withColumns(
        {
            **entry_columns(
                ready & up, ready & ~up, c("close"), c("stop_mult") * reach, c("target_mult") * reach,
                text("BUY"), text("SELL"),
            ),
            "size_mult": c("position_multiplier"),
            "confidence": confidence,
            "exit_long": leave,
            "exit_short": leave,
        }
    )


def signal_rates(signals: DataFrame, keys=("symbol",), regime="regime_name") -> DataFrame:
    """Bars, entries and entry rate per regime."""
    traded = F.count_if(c("action").isin("buy", "sell"))
    return signals.groupBy(*keys, regime).agg(
        F.count(F.lit(1)).alias("signals"), traded.alias("trades"), (traded / F.count(F.lit(1)) * 100).alias("trade_rate")
    )


def custom_rule(bars: DataFrame, rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a user's function from bars to signal columns and check what it returns."""
    out = rule(bars)
    missing = [n for n in SIGNAL_COLUMNS[:4] if n not in out.columns]
    if missing:
        raise ValueError(f"rule lacks columns: {', '.join(missing)}")
    for n in ("exit_long", "exit_short"):
        if n not in out.columns:
            out = out.withColumn(n, F.lit(0))
    return out
