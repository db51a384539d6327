"""Targets and market regimes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.functions.guards import c, div, div0, flag, pct_change
from candela.functions.series import RN, Series, bar_series, middle, on_series, running, strip
from candela.operators.indicators import Indicator, indicator

# ---- targets ------------------------------------------------------------------


def future_return(close: Column, ahead: Column) -> Column:
    return pct_change(ahead, close)


def add_targets(
    bars: DataFrame, forward=5, threshold=0.001, tail: str = "null", series: Series | None = None
) -> DataFrame:
    """Return ``forward`` bars ahead and its 3-class, binary and regression targets.

    ``tail`` decides the bars without a future: ``null`` leaves their classes
    empty, ``zero`` puts them in class 0.
    """
    def stage(df, f):
        r = F.col("future_return")
        three = F.when(r > threshold, 1).when(r < -threshold, -1).when(r.isNotNull(), 0)
        two = F.when(r > 0, 1).when(r.isNotNull(), 0)
        if tail == "zero":
            three, two = F.coalesce(three, F.lit(0)), F.coalesce(two, F.lit(0))
        return df.withColumn("future_return", future_return(c("close"), f.lead("close", forward))).withColumns(
            {"target_class": three, "target_binary": two, "target_regression": r}
        )

    return on_series(bars, series or bar_series(), stage, lookahead=forward)


def add_binary_target(
    bars: DataFrame, periods=1, threshold=0.0, out="target", tail="null", series: Series | None = None
) -> DataFrame:
    """1 when the return over the next ``periods`` bars exceeds the threshold."""
    def stage(df, f):
        up = pct_change(f.lead("close", periods), "close") > threshold
        return df.withColumn(out, flag(up) if tail == "zero" else up.cast("int"))

    return on_series(bars, series or bar_series(), stage, lookahead=periods)


def add_horizon_targets(bars: DataFrame, horizons=(1, 3, 5, 10), series: Series | None = None) -> DataFrame:
    def stage(df, f):
        return df.withColumns(
            {f"target_{h}": (pct_change(f.lead("close", h), "close") > 0).cast("int") for h in horizons}
        )

    return on_series(bars, series or bar_series(), stage, lookahead=max(horizons))


def label_distribution(bars: DataFrame, forward=5, series: Series | None = None) -> DataFrame:
    """Class counts of the binary label per symbol and the imbalance ratio."""
    labelled = add_binary_target(bars, forward, out="label", series=series).where("label IS NOT NULL")
    counts = labelled.groupBy("symbol").agg(
        F.count_if(F.col("label") == 0).alias("sell_hold"),
        F.count_if(F.col("label") == 1).alias("buy"),
        F.count(F.lit(1)).alias("labelled"),
    )
    return counts.withColumns(
        {
            "sell_hold_pct": 100 * div(c("sell_hold"), c("labelled")),
            "buy_pct": 100 * div(c("buy"), c("labelled")),
            "imbalance_ratio": div0(c("sell_hold"), c("buy")),
        }
    )


# ---- regime by long average ------------------------------------------------------

# Thresholds of the average-based regimes.
PRICE_VS_MA, MA_SLOPE, TREND_UP, TREND_DOWN, VOL_RATIO = 0.02, 0.01, 0.6, 0.4, 1.5
BEAR, SIDEWAYS, BULL, VOLATILE = 0, 1, 2, 3
REGIME_NAMES = {BEAR: "bear", SIDEWAYS: "sideways", BULL: "bull", VOLATILE: "volatile"}


def classify(price_vs_ma: Column, slope: Column, strength: Column, stormy: Column) -> Column:
    """Volatile beats bear beats bull; sideways otherwise."""
    return (
        F.when(stormy, VOLATILE)
        .when((price_vs_ma < -PRICE_VS_MA) & (slope < -MA_SLOPE) & (strength < TREND_DOWN), BEAR)
        .when((price_vs_ma > PRICE_VS_MA) & (slope > MA_SLOPE) & (strength > TREND_UP), BULL)
        .otherwise(SIDEWAYS)
    )


def regime_features(ma=200, trend=50, vol=20) -> Indicator:
    """Eight regime columns and the class of each bar."""
    return indicator(
        ma + trend,
        lambda f: {"_reg_ret": pct_change("close", f.lag("close")), "ma_200": f.full("close", ma)},
        lambda f: {
            "price_vs_ma_200": pct_change("close", "ma_200"),
            "above_ma_200": flag(c("close") > c("ma_200")),
            "ma_200_slope": pct_change("ma_200", f.lag("ma_200", trend)),
            "volatility_20d": f.full("_reg_ret", vol, F.stddev_samp),
            "volatility_200d": f.full("_reg_ret", ma, F.stddev_samp),
        },
        lambda f: {
            "trend_strength": f.full("above_ma_200", trend),
            "volatility_regime": div("volatility_20d", "volatility_200d"),
        },
        lambda f: {
            "regime": classify(
                c("price_vs_ma_200"), c("ma_200_slope"), c("trend_strength"), c("volatility_regime") > VOL_RATIO
            )
        },
    )


def regime_as_of(bars: DataFrame, ma=200, trend=50, vol=20, series: Series | None = None) -> DataFrame:
    """Regime each bar would be given if it were the newest one.

    Differs from :func:`regime_features` in the slope lag (``trend`` - 1) and in
    comparing volatility with its mean over the whole past.
    """
    series = series or bar_series()

    inputs = indicator(
        ma + trend,
        lambda f: {"_ret": pct_change("close", f.lag("close")), "ma_200": f.full("close", ma)},
        lambda f: {
            "ma_slope": pct_change("ma_200", f.lag("ma_200", trend - 1)),
            "volatility": f.full("_ret", vol, F.stddev_samp),
            "long_vol": f.full("_ret", ma, F.stddev_samp),
            "price_vs_ma": pct_change("close", "ma_200"),
            "_above": flag(c("close") > c("ma_200")),
        },
        lambda f: {"trend_strength": F.sum("_above").over(f.rows(trend)) / trend},
    )
    df = on_series(bars, series, inputs.stage, inputs.lookback, keep_helpers=True, means=inputs.means)
    df = running(
        df, series, {"_sum": ("sum", c("long_vol")), "_n": ("sum", F.when(c("long_vol").isNotNull(), 1))}
    )
    df = df.withColumn("avg_volatility", div("_sum", "_n"))
    stormy = c("volatility") > c("avg_volatility") * VOL_RATIO
    regime = F.when(
        c(RN) >= ma, classify(c("price_vs_ma"), c("ma_slope"), c("trend_strength"), stormy)
    ).otherwise(SIDEWAYS)
    return strip(df.withColumn("regime", regime).drop("long_vol", "_sum", "_n"))


# Trading parameters per regime.
REGIME_PARAMETERS = [
    ("bear", 0, 0.65, 0.015, 1.5, 2.0, 0.02),
    ("sideways", 1, 0.55, 0.020, 2.0, 3.0, 0.03),
    ("bull", 2, 0.50, 0.025, 2.5, 4.0, 0.04),
    ("volatile", 3, 0.70, 0.010, 3.0, 2.5, 0.015),
]
PARAMETER_SCHEMA = (
    "regime_name string, regime int, confidence_threshold double, position_size_pct double,"
    " stop_loss_atr_mult double, take_profit_atr_mult double, max_daily_loss_pct double"
)


def regime_parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIME_PARAMETERS, PARAMETER_SCHEMA)


def with_regime_parameters(df: DataFrame) -> DataFrame:
    """Look up the trading parameters of the ``regime`` code (four rows, so broadcast)."""
    return df.join(F.broadcast(regime_parameters(df.sparkSession)), "regime", "left")


def regime_statistics(with_regime: DataFrame, series: Series | None = None) -> DataFrame:
    """Per regime: bars, share, and statistics of returns taken between successive bars of that regime."""
    series = series or bar_series()
    keyed = Series((*series.keys, "regime"), series.order, series.cell, series.chunk_rows)
    stepped = on_series(
        with_regime, keyed, lambda df, f: df.withColumn("_r", pct_change("close", f.lag("close"))), 1
    )
    keys = list(series.keys)
    stats = stepped.groupBy(*keys, "regime").agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("_r").alias("_m"),
        F.stddev_samp("_r").alias("_s"),
        F.max("_r").alias("_hi"),
        F.min("_r").alias("_lo"),
    )
    total = F.sum("days").over(Window.partitionBy(*keys))
    m, s = c("_m"), c("_s")
    return stats.select(
        *keys,
        "regime",
        "days",
        (100 * div(c("days"), total)).alias("pct_of_total"),
        (m * 100).alias("avg_return"),
        (s * 100).alias("volatility"),
        F.when(s > 0, div(m, s) * math.sqrt(252)).otherwise(0.0).alias("sharpe"),
        (c("_hi") * 100).alias("max_gain"),
        (c("_lo") * 100).alias("max_loss"),
    )


def latest(df: DataFrame, keys=("symbol",), order: str = "ts") -> DataFrame:
    """Newest row per key; the rank filter keeps one row per key and task before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def current_regime(bars: DataFrame, series: Series | None = None) -> DataFrame:
    return with_regime_parameters(latest(regime_as_of(bars, series=series)))


# ---- regime by range and momentum ---------------------------------------------------

# Thresholds of the range-based regimes, in percent.
HIGH_VOL, BEAR_VOL, STRONG_TREND, STRONG_MOMENTUM, MIN_ROWS = 3.0, 2.0, 3.0, 10.0, 50


def regime_inputs(df: DataFrame, momentum_percent: bool = True) -> DataFrame:
    """Volatility, trend and momentum from features ``atr_14, sma_50, sma_200, roc_20``.

    ``momentum_percent=False`` keeps the rate of change as a fraction, which
    leaves the momentum rule without effect.
    """
    k, a, b = c("close"), c("sma_50"), c("sma_200")
    up = (k > a) & (a > b)
    down = (k < a) & (a < b)
    return df.withColumns(
        {
            "volatility": 100 * div("atr_14", "close"),
            "trend_direction": F.when(up, 1).when(down, -1).otherwise(0),
            "trend_strength": 100 * div(F.abs(a - b), b),
            "momentum": c("roc_20") * (100.0 if momentum_percent else 1.0),
        }
    )


def regime_inputs_fallback(lookback=50) -> Indicator:
    """The same inputs from closes alone: return deviation, least-squares slope, 19-bar momentum."""
    n = lookback

    return indicator(
        n,
        lambda f: {"_ret": pct_change("close", f.lag("close")), "_x": c(RN).cast("double")},
        lambda f: {
            "volatility": f.full("_ret", n - 1, F.stddev_samp) * math.sqrt(252) * 100,
            "_slope": F.when(F.count("close").over(f.rows(n)) == n, F.regr_slope("close", "_x").over(f.rows(n))),
            "_mean": f.full("close", n),
            "momentum": 100 * pct_change("close", f.lag("close", 19)),
        },
        lambda f: {
            "trend_direction": F.coalesce(F.signum("_slope"), F.lit(0)).cast("int"),
            "trend_strength": div(F.abs("_slope"), "_mean") * 100 * n,
        },
    )


def classify_range_regime(df: DataFrame) -> DataFrame:
    """Volatile, bear, bull, sideways in that order, with confidence and reason."""
    v, t, d, m = c("volatility"), c("trend_strength"), c("trend_direction"), c("momentum")
    ratio = lambda x, top: F.least(x / top, F.lit(2.0))
    falling = m < -STRONG_MOMENTUM
    stormy, rising = v > HIGH_VOL, (d == 1) & (t > STRONG_TREND)
    bearish = ((d == -1) & (t > STRONG_TREND)) | (falling & (v > BEAR_VOL))
    bear_conf = F.greatest(
        F.when(d == -1, ratio(t, STRONG_TREND)).otherwise(0.0),
        F.when(falling, ratio(F.abs(m), STRONG_MOMENTUM)).otherwise(0.0),
    )
    known = v.isNotNull() & t.isNotNull()
    return df.withColumns(
        {
            "regime_name": F.when(~known, "UNKNOWN").when(stormy, "VOLATILE").when(bearish, "BEAR")
            .when(rising, "BULL").otherwise("SIDEWAYS"),
            "regime_confidence": F.when(~known, 0.0).when(stormy, ratio(v, HIGH_VOL)).when(bearish, bear_conf)
            .when(rising, ratio(t, STRONG_TREND)).otherwise(1.0),
            "regime_reason": F.when(~known, "Insufficient data")
            .when(stormy, F.format_string("High volatility (%.1f%%)", v))
            .when(bearish, F.format_string("Bearish conditions (trend: %.1f%%, momentum: %.1f%%)", t, m))
            .when(rising, F.format_string("Strong uptrend (strength: %.1f%%)", t))
            .otherwise(F.format_string("No clear trend (strength: %.1f%%)", t)),
        }
    )


# Threshold change, size multiplier, balanced model?, stop and target multiples per regime.
ADAPTIVE_SETTINGS = [
    ("BULL", -0.10, 1.0, True, 1.5, 3.0),
    ("BEAR", 0.15, 0.5, False, 1.0, 2.0),
    ("VOLATILE", 0.20, 0.3, False, 3.0, 2.0),
    ("SIDEWAYS", 0.05, 0.7, True, 2.0, 2.5),
    ("UNKNOWN", 0.10, 0.5, True, 2.0, 2.5),
]
ADAPTIVE_SCHEMA = (
    "regime_name string, adjustment double, position_multiplier double, use_balanced boolean,"
    " stop_mult double, target_mult double"
)


def with_adaptive_settings(
    df: DataFrame, base=0.60, adapt=True, skip_volatile=False, skip_bear=False
) -> DataFrame:
    """Threshold, size multiplier, model choice and skip flag of ``regime_name`` (five rows, so broadcast)."""
    table = df.sparkSession.createDataFrame(ADAPTIVE_SETTINGS, ADAPTIVE_SCHEMA)
    name = c("regime_name")
    skip = (name == "VOLATILE") & F.lit(skip_volatile) | (name == "BEAR") & F.lit(skip_bear)
    return (
        df.join(F.broadcast(table), "regime_name", "left")
        .withColumns(
            {
                "confidence_threshold": F.greatest(
                    F.lit(0.5), F.least(F.lit(0.9), F.lit(float(base)) + c("adjustment"))
                ),
                "skip_trading": skip & F.lit(adapt),
            }
        )
        .drop("adjustment")
    )


# ---- binary regime flags -----------------------------------------------------------


def regime_flags() -> Indicator:
    """Ten 0/1 flags from ``adx_14, sma_50, sma_200, volatility_20, rsi_14``."""
    def flags(f):
        k, a, b, v = c("close"), c("sma_50"), c("sma_200"), c("volatility_20")
        return {
            "regime_trending": flag(c("adx_14") > 25),
            "regime_ranging": flag(c("adx_14") < 20),
            "regime_bull": flag((k > a) & (a > b) & (c("_step") > 0)),
            "regime_bear": flag((k < a) & (a < b) & (c("_step") < 0)),
            "regime_high_vol": flag(v > c("_med") * 1.5),
            "regime_low_vol": flag(v < c("_med") * 0.7),
            "regime_overbought": flag(c("rsi_14") > 70),
            "regime_oversold": flag(c("rsi_14") < 30),
            "regime_uptrend": flag(c("_top") > f.lag("_top", 20)),
            "regime_downtrend": flag(c("_bottom") < f.lag("_bottom", 20)),
        }

    return indicator(
        121,
        lambda f: {
            "_step": c("sma_50") - f.lag("sma_50", 5),
            "_vols": F.sort_array(F.collect_list("volatility_20").over(f.rows(100))),
            "_top": f.full("close", 20, F.max),
            "_bottom": f.full("close", 20, F.min),
        },
        lambda f: {"_med": middle("_vols", 20)},
        flags,
    )


def distribution(df: DataFrame, column: str, keys=("symbol",)) -> DataFrame:
    """Counts and percentages of a column's values per key."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("pct", 100 * div(c("n"), total))


def dominant_regime(labelled: DataFrame, splits: DataFrame, name="regime_name") -> DataFrame:
    """Regime seen most often at the first, middle and last test bar of each split; ties go to the earliest.

    ``labelled`` carries ``rn``; ``splits`` carries ``test_from, test_to`` row numbers.
    """
    half = F.expr("(test_to - test_from + 1) div 2")
    points = splits.select(
        "symbol",
        "split_num",
        F.posexplode(F.array(c("test_from"), c("test_from") + half, c("test_to"))).alias("_point", "rn"),
    )
    seen = points.join(labelled.select("symbol", "rn", name), ["symbol", "rn"])
    votes = seen.groupBy("symbol", "split_num", name).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_point").alias("_p")
    )
    # at most three rows per split: more votes first, then the earlier point
    best = F.max_by(name, c("_n") * 10 - c("_p"))
    return votes.groupBy("symbol", "split_num").agg(best.alias("dominant_regime"))
