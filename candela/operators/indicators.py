"""Technical indicators as window expressions.

An indicator is a short list of levels.  A level maps column names to window
expressions over columns of earlier levels, so levels of many indicators merge
into one projection each and Spark plans few window nodes.  Called with a table
an indicator runs by itself; :func:`feature_set` merges them all, so that they
share one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.guards import c, div, flag, ln_or_null, pct_change
from candela.functions.series import Frame, Means, Series, bar_series, on_series, running, strip

Level = Callable[[Frame], dict[str, Column]]


@dataclass(frozen=True)
class Indicator:
    """Levels of columns and how many earlier rows they look at; names with ``_`` in front are scratch."""

    levels: tuple[Level, ...]
    lookback: int
    means: Means = field(default_factory=dict)  # exponential means of columns that the bars have

    def stage(self, df: DataFrame, f: Frame | None) -> DataFrame:
        before = set(df.columns)
        for level in self.levels:
            df = df.withColumns(level(f))
        return df.drop(*[n for n in df.columns if n.startswith("_") and n not in before])

    def __call__(self, bars: DataFrame, series: Series | None = None) -> DataFrame:
        if not self.lookback and not self.means:
            return self.stage(bars, None)  # row by row: no positions, no shuffle
        return on_series(bars, series or bar_series(), self.stage, self.lookback, means=self.means)


def indicator(lookback: int, *levels: Level) -> Indicator:
    return Indicator(levels, lookback)


def chain(*parts: Indicator) -> Indicator:
    """Indicators that read each other's columns: levels follow each other and lookbacks add up."""
    return Indicator(sum((p.levels for p in parts), ()), sum(p.lookback for p in parts), _all_means(parts))


def beside(*parts: Indicator) -> Indicator:
    """Independent indicators: levels of equal depth merge."""
    def merged(depth: int) -> Level:
        return lambda f: {k: v for p in parts if depth < len(p.levels) for k, v in p.levels[depth](f).items()}

    depth = max(len(p.levels) for p in parts)
    return Indicator(tuple(merged(i) for i in range(depth)), max(p.lookback for p in parts), _all_means(parts))


def _all_means(parts: tuple[Indicator, ...]) -> Means:
    return {k: v for p in parts for k, v in p.means.items()}


# ---- averages -------------------------------------------------------------


def sma(periods=(20, 50, 200), price="close") -> Indicator:
    return indicator(max(periods), lambda f: {f"sma_{n}": f.full(price, n) for n in periods})


def ema_of(specs: dict[str, tuple[str, int]]) -> Indicator:
    """Exponential means ``{output: (column, span)}`` of columns that the bars have."""
    return Indicator((lambda f: f.ema_sums(specs), lambda f: f.ema_values(specs)), 0, dict(specs))


def ema(periods=(12, 26, 50), price="close") -> Indicator:
    return ema_of({f"ema_{n}": (price, n) for n in periods})


def rsi(period=14, price="close") -> Indicator:
    def value(f):
        up, down = c("_rsi_up"), c("_rsi_down")
        return {
            f"rsi_{period}": F.when(down != 0, 100 - 100 / (1 + div(up, down))).when(up > 0, F.lit(100.0))
        }

    zero = F.lit
    return indicator(
        period + 1,
        lambda f: {
            "_gain": F.coalesce(F.greatest(c(price) - f.lag(price), zero(0.0)), zero(0.0)),
            "_loss": F.coalesce(F.greatest(f.lag(price) - c(price), zero(0.0)), zero(0.0)),
        },
        lambda f: {"_rsi_up": f.full("_gain", period), "_rsi_down": f.full("_loss", period)},
        value,
    )


def macd(fast=12, slow=26, signal=9, price="close") -> Indicator:
    """Difference of two exponential means, its own exponential mean, and their difference.

    A mean of a mean is a mix of the two means (partial fractions), so the signal line needs means of the price only.
    """
    if signal in (fast, slow):
        raise ValueError("the signal's span must differ from the other two")
    share = lambda span: 2.0 / (span + 1)
    decay = lambda span: 1 - share(span)

    def smoothed(span, name):
        apart = decay(signal) - decay(span)
        return (share(span) * decay(signal) * c("_macd_signal") - share(signal) * decay(span) * c(name)) / apart

    return chain(
        ema_of({"_macd_fast": (price, fast), "_macd_slow": (price, slow), "_macd_signal": (price, signal)}),
        indicator(
            0,
            lambda f: {
                "macd": c("_macd_fast") - c("_macd_slow"),
                "macd_signal": smoothed(fast, "_macd_fast") - smoothed(slow, "_macd_slow"),
            },
            lambda f: {"macd_hist": c("macd") - c("macd_signal")},
        ),
    )


def bollinger(period=20, width=2.0, price="close") -> Indicator:
    n = period
    def bands(f):
        mid, reach = c(f"bb_middle_{n}"), width * c("_bb_sd")
        return {f"bb_upper_{n}": mid + reach, f"bb_lower_{n}": mid - reach}

    def place(f):
        up, low = c(f"bb_upper_{n}"), c(f"bb_lower_{n}")
        return {f"bb_width_{n}": up - low, f"bb_position_{n}": div(c(price) - low, up - low)}

    return indicator(
        n,
        lambda f: {f"bb_middle_{n}": f.full(price, n), "_bb_sd": f.full(price, n, F.stddev_samp)},
        bands,
        place,
    )


def true_range(f: Frame, first_from_range: bool = True) -> Column:
    """Largest of high-low and the distances to the previous close."""
    before = f.lag("close")
    tr = F.greatest(c("high") - c("low"), F.abs(c("high") - before), F.abs(c("low") - before))
    return tr if first_from_range else F.when(before.isNotNull(), tr)


def atr(period=14) -> Indicator:
    return indicator(
        period + 1,
        lambda f: {"_tr": true_range(f)},
        lambda f: {f"atr_{period}": f.full("_tr", period)},
        lambda f: {f"atr_percent_{period}": 100 * div(f"atr_{period}", "close")},
    )


def stochastic(k=14, d=3) -> Indicator:
    return indicator(
        k + d,
        lambda f: {"_st_lo": f.full("low", k, F.min), "_st_hi": f.full("high", k, F.max)},
        lambda f: {f"stoch_k_{k}": 100 * div(c("close") - c("_st_lo"), c("_st_hi") - c("_st_lo"))},
        lambda f: {f"stoch_d_{d}": f.full(f"stoch_k_{k}", d)},
    )


def adx_simple(period=14) -> Indicator:
    """Directional index from simple means, both movements clipped on their own."""
    n = period
    rise = lambda a, b: F.when(b.isNotNull() & a.isNotNull(), F.greatest(a - b, F.lit(0.0)))

    def spread_of(f):
        p, m = c(f"plus_di_{n}"), c(f"minus_di_{n}")
        return {"_dx": 100 * div(F.abs(p - m), p + m)}

    return indicator(
        2 * n + 1,
        lambda f: {
            "_tr": true_range(f), "_dm_up": rise(c("high"), f.lag("high")), "_dm_dn": rise(f.lag("low"), c("low")),
        },
        lambda f: {"_adx_tr": f.full("_tr", n), "_adx_up": f.full("_dm_up", n), "_adx_dn": f.full("_dm_dn", n)},
        lambda f: {
            f"plus_di_{n}": 100 * div("_adx_up", "_adx_tr"), f"minus_di_{n}": 100 * div("_adx_dn", "_adx_tr"),
        },
        spread_of,
        lambda f: {f"adx_{n}": f.full("_dx", n)},
    )


def cci(period=20) -> Indicator:
    n = period
    off = lambda: F.aggregate("_cci_win", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_cci_mean"))) / n
    return indicator(
        n,
        lambda f: {"_tp": (c("high") + c("low") + c("close")) / 3},
        lambda f: {"_cci_mean": f.full("_tp", n), "_cci_win": F.collect_list("_tp").over(f.rows(n))},
        lambda f: {f"cci_{n}": div(c("_tp") - c("_cci_mean"), 0.015 * off())},
    )


def williams_r(period=14) -> Indicator:
    return indicator(
        period,
        lambda f: {"_wr_hi": f.full("high", period, F.max), "_wr_lo": f.full("low", period, F.min)},
        lambda f: {f"williams_r_{period}": -100 * div(c("_wr_hi") - c("close"), c("_wr_hi") - c("_wr_lo"))},
    )


# ---- price, volatility, volume -----------------------------------------------


def returns() -> Indicator:
    return indicator(
        1,
        lambda f: {
            "returns": pct_change("close", f.lag("close")), "log_returns": ln_or_null(div("close", f.lag("close"))),
        },
    )


def lagged_returns(lags=(1, 2, 3, 5, 10)) -> Indicator:
    """Needs ``returns``."""
    return indicator(max(lags), lambda f: {f"returns_lag_{k}": f.lag("returns", k) for k in lags})


def momentum(periods=(5, 10, 20)) -> Indicator:
    return indicator(
        max(periods), lambda f: {f"momentum_{n}": pct_change("close", f.lag("close", n)) for n in periods}
    )


def bar_ratios() -> Indicator:
    return indicator(
        0,
        lambda f: {
            "hl_ratio": div(c("high") - c("low"), "close"), "co_ratio": div(c("close") - c("open"), "close"),
        },
    )


def gap() -> Indicator:
    return indicator(1, lambda f: {"gap": pct_change("open", f.lag("close"))})


def volatility(periods=(10, 20, 50)) -> Indicator:
    """Needs ``returns``."""
    year = math.sqrt(252)
    return indicator(
        max(periods), lambda f: {f"volatility_{n}": f.full("returns", n, F.stddev_samp) * year for n in periods}
    )


def parkinson(periods=(10, 20)) -> Indicator:
    return indicator(
        max(periods),
        lambda f: {"_hl2": F.pow(ln_or_null(div("high", "low")), F.lit(2.0))},
        lambda f: {
            f"parkinson_vol_{n}": F.sqrt(f.full("_hl2", n, F.sum) / (4 * n * math.log(2))) for n in periods
        },
    )


def vol_of_vol(period=20) -> Indicator:
    """Needs ``volatility_20``."""
    return indicator(period, lambda f: {"vol_of_vol": f.full("volatility_20", period, F.stddev_samp)})


def volume_features() -> Indicator:
    return indicator(
        20,
        lambda f: {
            "volume_sma_20": f.full("volume", 20), "volume_momentum": pct_change("volume", f.lag("volume", 5)),
        },
        lambda f: {"volume_ratio": div("volume", "volume_sma_20")},
    )


def time_features(ts="ts") -> Indicator:
    def parts(f):
        hour, dow, month = F.hour(ts), F.weekday(ts), F.month(ts)
        cols = {
            "hour": hour,
            "day_of_week": dow,
            "day_of_month": F.dayofmonth(ts),
            "week_of_year": F.weekofyear(ts),
            "month": month,
        }
        for name, part, whole in (("hour", hour, 24), ("day", dow, 7), ("month", month, 12)):
            turn = part * (2 * math.pi / whole)
            cols[f"{name}_sin"], cols[f"{name}_cos"] = F.sin(turn), F.cos(turn)
        for name, start in (("asian", 0), ("european", 8), ("us", 16)):
            cols[f"{name}_session"] = flag((hour >= start) & (hour < start + 8))
        return cols

    return indicator(0, parts)


def candle_shapes() -> Indicator:
    def shapes(f):
        o, h, l, k = c("open"), c("high"), c("low"), c("close")
        body = F.abs(k - o)
        return {
            "doji": flag(div(body, h - l) < 0.1),
            "hammer": flag((F.least(o, k) - l > 2 * body) & (h - F.greatest(o, k) < body)),
        }

    return indicator(0, shapes)


def engulfing() -> Indicator:
    def pairs(f):
        o, k, po, pk = c("open"), c("close"), f.lag("open"), f.lag("close")
        return {
            "bullish_engulfing": flag((k > o) & (po > pk) & (k > po) & (o < pk)),
            "bearish_engulfing": flag((o > k) & (pk > po) & (o > pk) & (k < po)),
        }

    return indicator(1, pairs)


def momentum_features(periods=(5, 10, 20)) -> Indicator:
    """Needs ``returns``."""
    return indicator(
        max(periods),
        lambda f: {
            **{f"roc_{n}": pct_change("close", f.lag("close", n)) for n in periods},
            "momentum_oscillator": c("close") - f.lag("close", 10),
            "price_acceleration": c("returns") - f.lag("returns"),
        },
    )


def trend_fallback() -> Indicator:
    """Trend features from averages: needs sma_20/50/200 and ema_12/26."""
    return indicator(
        5,
        lambda f: {
            "trend_strength": div(F.abs(c("ema_12") - c("ema_26")), "close"),
            **{f"price_vs_sma_{n}": pct_change("close", f"sma_{n}") for n in (20, 50, 200)},
            **{f"sma_{n}_slope": div(c(f"sma_{n}") - f.lag(f"sma_{n}", 5), f"sma_{n}") for n in (20, 50)},
        },
    )


def vol_percentile(window=100) -> Indicator:
    """Percent rank of the last ``volatility_20`` among the last ``window`` values, ties averaged."""
    def rank(f):
        x = F.col("volatility_20")
        weight = lambda v: F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0)
        below = F.aggregate("_vp_win", F.lit(0.0), lambda a, v: a + weight(v))
        return {"vol_percentile": F.when(F.size("_vp_win") == window, (below + 0.5) / window)}

    return indicator(
        window,
        lambda f: {"_vp_win": F.collect_list("volatility_20").over(f.rows(window))},
        rank,
        lambda f: {
            "high_vol_regime": flag(c("vol_percentile") > 0.7), "low_vol_regime": flag(c("vol_percentile") < 0.3),
        },
    )


def price_channel(period=20) -> Indicator:
    """Highest high and lowest low of the ``period`` bars before the current one."""
    return indicator(
        period + 1,
        lambda f: {"_ch_hi": f.full("high", period, F.max), "_ch_lo": f.full("low", period, F.min)},
        lambda f: {f"channel_high_{period}": f.lag("_ch_hi"), f"channel_low_{period}": f.lag("_ch_lo")},
    )


def close_std(period=14) -> Indicator:
    return indicator(period, lambda f: {f"close_std_{period}": f.full("close", period, F.stddev_samp)})


def momentum_80_20(short=10, long=20, roc=10, atr_period=14) -> Indicator:
    """Columns of the 80/20 momentum rules; the range of the first bar is unknown there."""
    return indicator(
        max(short, long, roc, atr_period) + 1,
        lambda f: {
            "sma_short": f.full("close", short),
            "sma_long": f.full("close", long),
            "roc": 100 * pct_change("close", f.lag("close", roc)),
            "tr": true_range(f, first_from_range=False),
        },
        lambda f: {"atr": f.full("tr", atr_period), "trend_strength": 100 * pct_change("sma_short", "sma_long")},
    )


# First day of the rate-rise calendar flag, and the fear levels of the volatility proxy.
HAWKISH_FROM = "2022-01-01"
FEAR_LEVELS = (25.0, 35.0)


def index_specific(hawkish_from: str = HAWKISH_FROM) -> Indicator:
    """Index extras: volatility regime, volatility proxy with fear level, calendar flags. Needs ``returns``."""
    def flags(f):
        vix, left = c("vix_proxy"), F.datediff(F.last_day("ts"), F.to_date("ts"))
        return {
            "high_vol": flag(c("volatility_regime") > f.full("volatility_regime", 60)),
            "fear_level": F.when(vix > FEAR_LEVELS[1], 2).when(vix > FEAR_LEVELS[0], 1).otherwise(0),
            "fed_hawkish": flag(F.to_date("ts") >= F.lit(hawkish_from).cast("date")),
            "days_to_month_end": left,
            "month_end_period": flag(left <= 3),
        }

    return indicator(
        80,
        lambda f: {
            "volatility_regime": f.full("returns", 20, F.stddev_samp),
            "vix_proxy": f.full("returns", 10, F.stddev_samp) * math.sqrt(252) * 100,
        },
        flags,
    )


# ---- running sums -------------------------------------------------------------


OBV_STEP = indicator(1, lambda f: {"obv_step": F.signum(c("close") - f.lag("close")) * c("volume")})
PVT_STEP = indicator(1, lambda f: {"pvt_step": pct_change("close", f.lag("close")) * c("volume")})


def volume_sums(bars: DataFrame, series: Series, step: Indicator) -> DataFrame:
    """Running sums of the volume steps, positions kept."""
    stepped = on_series(bars, series, step.stage, step.lookback, keep_helpers=True)
    made = [n for n in ("obv_step", "pvt_step") if n in stepped.columns]
    # on-balance volume starts at 0, the trend is unknown on the first bar
    start = {"obv_step": F.coalesce(F.col("obv_step"), F.lit(0.0)), "pvt_step": F.col("pvt_step")}
    return running(stepped, series, {n[:3]: ("sum", start[n]) for n in made}).drop(*made)


def add_obv(bars: DataFrame, series: Series | None = None, ema_span: int | None = 20) -> DataFrame:
    """On-balance volume from 0, with its exponential mean."""
    series = series or bar_series()
    out = volume_sums(bars, series, OBV_STEP)
    return ema_of({"obv_ema": ("obv", ema_span)})(out, series) if ema_span else strip(out)


def add_pvt(bars: DataFrame, series: Series | None = None) -> DataFrame:
    """Price-volume trend; null on the first bar."""
    return strip(volume_sums(bars, series or bar_series(), PVT_STEP))


# ---- summaries ----------------------------------------------------------------


def crossover_counts(bars: DataFrame, fast=10, slow=20, roc=10, threshold=0.5, series=None) -> DataFrame:
    """Average crossings and the share of bars that meet each entry condition."""
    df = momentum_80_20(fast, slow, roc)(bars, series)
    df = on_series(
        df,
        series or bar_series(),
        lambda d, f: d.withColumns({"_pf": f.lag("sma_short"), "_ps": f.lag("sma_long")}),
        1,
    )
    s, l, ps, pl = c("sma_short"), c("sma_long"), c("_pf"), c("_ps")
    share = lambda cond: F.avg(flag(cond))
    return df.groupBy("symbol").agg(
        F.count_if((ps <= pl) & (s > l)).alias("bullish_crossovers"),
        F.count_if((ps >= pl) & (s < l)).alias("bearish_crossovers"),
        share(s > l).alias("share_short_above_long"),
        share(c("roc") > threshold).alias("share_positive_roc"),
        share((c("roc") > threshold) & (s > l)).alias("share_buy_condition"),
    )


def buy_and_hold(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Return of the last close over the first close."""
    return bars.groupBy(*keys).agg(
        pct_change(F.max_by("close", "ts"), F.min_by("close", "ts")).alias("buy_hold_return")
    )


# ---- everything -----------------------------------------------------------------


def windowed_features(include_volume: bool = True) -> Indicator:
    """All features that look at a known number of rows."""
    from candela.operators.regimes import regime_features

    parts = [
        lagged_returns(),
        momentum(),
        bar_ratios(),
        gap(),
        sma((10, 20, 50, 200)),
        ema((12, 26, 50)),
        rsi(14),
        macd(),
        bollinger(20),
        atr(14),
        stochastic(),
        adx_simple(14),
        cci(20),
        williams_r(14),
        chain(volatility(), vol_of_vol()),
        parkinson(),
        time_features(),
        candle_shapes(),
        engulfing(),
        regime_features(),
        momentum_features(),
    ]
    if include_volume:
        parts += [volume_features(), ema_of({"obv_ema": ("obv", 20)})]
    return chain(returns(), beside(*parts))


OHLCV = ("open", "high", "low", "close", "volume")


def feature_columns(include_volume: bool = True) -> list[str]:
    """Feature names in their fixed order."""
    names = ["returns", "log_returns"] + [f"returns_lag_{k}" for k in (1, 2, 3, 5, 10)]
    names += [f"momentum_{n}" for n in (5, 10, 20)] + ["hl_ratio", "co_ratio", "gap"]
    names += [f"sma_{n}" for n in (10, 20, 50, 200)] + [f"ema_{n}" for n in (12, 26, 50)]
    names += ["rsi_14", "macd", "macd_signal", "macd_hist"]
    names += [f"bb_{p}_20" for p in ("middle", "upper", "lower", "width", "position")]
    names += ["atr_14", "atr_percent_14", "stoch_k_14", "stoch_d_3", "adx_14", "plus_di_14", "minus_di_14"]
    names += ["cci_20", "williams_r_14"]
    if include_volume:
        names += ["obv", "obv_ema", "volume_sma_20", "volume_ratio", "volume_momentum", "pvt"]
    names += [f"volatility_{n}" for n in (10, 20, 50)] + ["parkinson_vol_10", "parkinson_vol_20", "vol_of_vol"]
    names += ["hour", "day_of_week", "day_of_month", "week_of_year", "month"]
    names += [f"{p}_{g}" for p in ("hour", "day", "month") for g in ("sin", "cos")]
    names += [f"{p}_session" for p in ("asian", "european", "us")]
    names += ["doji", "hammer", "bullish_engulfing", "bearish_engulfing"]
    names += [f"roc_{n}" for n in (5, 10, 20)] + ["momentum_oscillator", "price_acceleration"]
    names += ["ma_200", "price_vs_ma_200", "above_ma_200", "ma_200_slope", "trend_strength"]
    names += ["volatility_20d", "volatility_200d", "volatility_regime", "regime"]
    return names


def feature_set(bars: DataFrame, include_volume: bool = True, series: Series | None = None) -> DataFrame:
    """Bars with all features in fixed order.

    Running sums come first, on the narrow bars; then one chunked windowing
    computes everything else.
    """
    series = series or bar_series()
    prices = [n for n in OHLCV if n in bars.columns]
    if include_volume:
        bars = volume_sums(bars, series, beside(OBV_STEP, PVT_STEP))
    out = windowed_features(include_volume)(bars, series)
    return out.select(*series.keys, *series.order, *prices, *feature_columns(include_volume))
