"""Walk-forward splits, their validation, and tables that compare runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.functions.keytables import per_key
from candela.functions.guards import c, div, flag, pct_change
from candela.functions.quantiles import exact_percentiles
from candela.functions.series import RN, Series, bar_series, index, strip

# ---- split tables ------------------------------------------------------------------


def number_rows(df: DataFrame, series: Series | None = None, out: str = "rn") -> DataFrame:
    """Add the 1-based position of each row in its series."""
    return strip(index(df, series or bar_series()).withColumn(out, F.col(RN)))


def series_lengths(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def row_splits(lengths: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Split bounds as row numbers: every window of ``train + test`` rows that fits, ``step`` rows apart."""
    window = train + test
    start = F.explode(F.sequence(F.lit(0), F.expr(f"(n - {window}) div {step}")))
    base = (c("split_num") - 1) * step
    return (
        lengths.where(c("n") >= window)
        .withColumn("split_num", start)
        .withColumn("split_num", c("split_num") + 1)
        .select(
            *[n for n in lengths.columns if n != "n"],
            c("split_num").cast("long").alias("split_num"),
            (base + 1).cast("long").alias("train_from"),
            (base + train).cast("long").alias("train_to"),
            (base + train + 1).cast("long").alias("test_from"),
            (base + window).cast("long").alias("test_to"),
        )
    )


def week_splits(lengths: DataFrame, train_weeks=8, test_weeks=2, step_weeks=None) -> DataFrame:
    """Splits in weeks of five rows, not overlapping unless a step is given."""
    step = step_weeks or train_weeks + test_weeks
    return row_splits(lengths, train_weeks * 5, test_weeks * 5, step * 5)


def month_splits(lengths: DataFrame, train_months=12, test_months=3, step_months=3) -> DataFrame:
    """Splits in months of 21 rows."""
    return row_splits(lengths, train_months * 21, test_months * 21, step_months * 21)


def assign_rows(numbered: DataFrame, lengths: DataFrame, train: int, test: int, step: int, warmup: int | None = None) -> DataFrame:
    """Copy each row into the splits that contain it, with its ``role``.

    The splits of a row follow from its number, so neither a range join nor the
    split table is needed; only the length of the series bounds them.  With
    ``warmup`` only so many train rows are kept, those just before the test
    part; indicators of series keyed by split then start anew in every split.
    """
    if warmup is not None and not 0 <= warmup <= train:
        raise ValueError("warm-up rows are the last ones of the train part")
    window, skipped = train + test, 0 if warmup is None else train - warmup
    keys = [n for n in lengths.columns if n != "n"]
    first = F.greatest(F.lit(0), F.ceil((c("rn") - window) / step))
    last = F.least(F.floor((c("rn") - skipped - 1) / step), F.floor((c("n") - window) / step))
    df = numbered.join(per_key(lengths.where(c("n") >= window)), keys)
    df = df.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last)))
    role = F.when(c("rn") - c("_k") * step <= train, "train").otherwise("test")
    return df.withColumns({"split_num": (c("_k") + 1).cast("long"), "role": role}).drop("_k", "n")


def calendar_splits(bars: DataFrame, train_days=180, test_days=60, step_days=60, keys=("symbol",)) -> DataFrame:
    """Splits in calendar days from the first bar of each series while they end within it."""
    span = bars.groupBy(*keys).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    whole = train_days + test_days
    fit = F.floor((F.timestamp_diff("SECOND", c("_first"), c("_last")) - whole * 86400) / (step_days * 86400))
    df = span.withColumn("_fit", fit).where("_fit >= 0").withColumn("_k", F.explode(F.sequence(F.lit(0), c("_fit"))))
    after = lambda days: c("_first") + F.make_dt_interval(c("_k") * step_days + days)
    return df.select(
        *keys,
        (c("_k") + 1).cast("long").alias("split_num"),
        after(F.lit(0)).alias("train_start"),
        after(F.lit(train_days)).alias("train_end"),
        after(F.lit(train_days)).alias("test_start"),
        after(F.lit(whole)).alias("test_end"),
    )


def month_iterations(spark: SparkSession, months: list[str], train_months: int = 12) -> DataFrame:
    """Named iterations: each month is tested after the ``train_months`` before it."""
    rows = spark.createDataFrame([(m,) for m in months], "month string")
    first = F.to_date(F.concat("month", F.lit("-01")))
    return rows.select(
        F.date_format(first, "MMM_yyyy").alias("name"),
        F.add_months(first, -train_months).alias("train_start"),
        F.date_sub(first, 1).alias("train_end"),
        first.alias("test_start"),
        F.last_day(first).alias("test_end"),
    )


def iteration_rows(bars: DataFrame, iterations: DataFrame, min_train=50, min_test=5) -> DataFrame:
    """Train and test rows per series and iteration, where both reach their minimum.

    ``iterations`` is a literal table of a few rows, so the range join broadcasts it.
    """
    day = F.to_date("ts")
    joined = bars.select("symbol", day.alias("_day")).join(
        F.broadcast(iterations), (c("_day") >= c("train_start")) & (c("_day") <= c("test_end"))
    )
    counted = joined.groupBy("symbol", "name").agg(
        F.count_if(c("_day") <= c("train_end")).alias("train_rows"),
        F.count_if(c("_day") >= c("test_start")).alias("test_rows"),
    )
    return counted.where((c("train_rows") >= min_train) & (c("test_rows") >= min_test))


def eras(df: DataFrame, ts: str, recent_from: str, older_from: str) -> DataFrame:
    """Dataset name of each row: recent, historical, or none before both."""
    day = F.to_date(ts)
    name = F.when(day >= F.lit(recent_from).cast("date"), "recent").when(
        day >= F.lit(older_from).cast("date"), "historical"
    )
    return df.withColumn("dataset", name).where("dataset IS NOT NULL")


# ---- split checks ----------------------------------------------------------------------


def split_summary(assigned: DataFrame, keys=("symbol",)) -> DataFrame:
    """Bounds, row counts and train ratio per split."""
    part = lambda role, value: F.when(c("role") == role, value)
    df = assigned.groupBy(*keys, "split_num").agg(
        F.min(part("train", c("ts"))).alias("train_start"),
        F.max(part("train", c("ts"))).alias("train_end"),
        F.min(part("test", c("ts"))).alias("test_start"),
        F.max(part("test", c("ts"))).alias("test_end"),
        F.count(part("train", c("ts"))).alias("train_rows"),
        F.count(part("test", c("ts"))).alias("test_rows"),
    )
    return df.withColumn("ratio", div(c("train_rows"), c("train_rows") + c("test_rows")))


def overlap(assigned: DataFrame, keys=("symbol",)) -> DataFrame:
    """Number of timestamps that a split has in both train and test."""
    both = assigned.groupBy(*keys, "split_num", "ts").agg(F.count_distinct("role").alias("_roles"))
    return both.groupBy(*keys, "split_num").agg(F.count_if(c("_roles") > 1).alias("overlap"))


def validate_splits(assigned: DataFrame, expected_ratio: float, keys=("symbol",)) -> DataFrame:
    """Per split: order, overlap, ratio within 5% and gap of at most a week to the next split."""
    df = split_summary(assigned, keys).join(overlap(assigned, keys), [*keys, "split_num"])
    # one row per split: the window runs over the summary, not over bars
    following = F.lead("train_start").over(Window.partitionBy(*keys).orderBy("split_num"))
    return df.select(
        *keys,
        "split_num",
        (c("train_end") < c("test_start")).alias("in_order"),
        "overlap",
        (F.abs(c("ratio") - expected_ratio) <= 0.05).alias("ratio_ok"),
        F.coalesce(following > c("test_end") + F.expr("INTERVAL 7 DAYS"), F.lit(False)).alias("gap_after"),
    )


def validation_report(checks: DataFrame, keys=("symbol",)) -> DataFrame:
    bad = ~c("in_order") | (c("overlap") > 0) | ~c("ratio_ok") | c("gap_after")
    return checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_splits"), F.count_if(bad).alias("issues"), (~F.bool_or(bad)).alias("valid")
    )


# ---- results over splits -----------------------------------------------------------------

RESULT_COLUMNS = ("total_return", "sharpe_ratio", "win_rate", "max_drawdown", "profit_factor", "trades")


def aggregate_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """Means, medians, spreads and shares over splits; consistency is 1 - deviation / |mean|."""
    ret, sharpe = c("total_return"), c("sharpe_ratio")
    share = lambda cond: 100 * F.avg(flag(cond).cast("double"))
    steady = lambda x: 1 - F.stddev_pop(x) / (F.abs(F.avg(x)) + 1e-6)
    df = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_splits"),
        F.sum("trades").alias("total_trades"),
        F.avg(ret).alias("avg_total_return"),
        F.stddev_pop(ret).alias("std_total_return"),
        F.avg(sharpe).alias("avg_sharpe_ratio"),
        F.avg("win_rate").alias("avg_win_rate"),
        F.avg("max_drawdown").alias("avg_max_drawdown"),
        F.max("max_drawdown").alias("max_max_drawdown"),
        F.avg(F.when(c("profit_factor") > 0, c("profit_factor"))).alias("avg_profit_factor"),
        share(ret > 0).alias("positive_returns_pct"),
        share(sharpe > 1).alias("sharpe_above_1_pct"),
        steady(ret).alias("return_consistency"),
        steady(sharpe).alias("sharpe_consistency"),
    )
    for name in ("total_return", "sharpe_ratio"):
        median = exact_percentiles(results, keys, name, [0.5]).drop("prob")
        df = df.join(median.withColumnRenamed("value", f"median_{name}"), keys)
    return df


def compare_datasets(aggregates: DataFrame, key: str = "dataset", values=("recent", "historical")) -> DataFrame:
    """Metrics as rows, datasets as columns."""
    names = [n for n, t in aggregates.dtypes if n != key and t in ("double", "bigint")]
    doubles = aggregates.select(key, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot(key, names, "metric", "value").groupBy("metric").pivot(key, list(values)).agg(F.first("value"))


def summarize_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """Summary with the sample deviation of returns."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("splits"),
        F.sum("trades").alias("total_trades"),
        F.avg("win_rate").alias("avg_win_rate"),
        F.avg("total_return").alias("avg_return"),
        F.stddev_samp("total_return").alias("std_return"),
        F.avg("sharpe_ratio").alias("avg_sharpe"),
        F.avg("max_drawdown").alias("avg_max_dd"),
        F.max("max_drawdown").alias("max_max_dd"),
        (100 * F.avg(flag(c("total_return") > 0).cast("double"))).alias("positive_pct"),
    )


def criteria(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Six pass/fail checks per summary row."""
    checks = [
        ("Minimum 3 walk-forward periods", c("splits") >= 3),
        ("Avg Win Rate > 50%", c("avg_win_rate") > 0.50),
        ("Avg Return > 0%", c("avg_return") > 0),
        ("Positive returns in >50% of periods", c("positive_pct") > 50),
        ("Avg Max Drawdown < 15%", c("avg_max_dd") < 0.15),
        ("Max Max Drawdown < 20%", c("max_max_dd") < 0.20),
    ]
    table = F.array(
        *[F.struct(F.lit(n).alias("criterion"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, ok in checks]
    )
    return summary.select(*keys, F.inline(table))


def criteria_verdict(checked: DataFrame, keys: list[str]) -> DataFrame:
    df = checked.groupBy(*keys).agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("checks"))
    verdict = F.when(c("passed") == c("checks"), "PASSED").when(c("passed") >= c("checks") * 0.7, "PROMISING")
    return df.withColumn("verdict", verdict.otherwise("NEEDS_WORK"))


def overall_stats(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum("trades").alias("total_trades"),
        F.avg("win_rate").alias("avg_win_rate"),
        F.avg("sharpe_ratio").alias("avg_sharpe"),
        F.stddev_samp("sharpe_ratio").alias("std_sharpe"),
        F.count_if(c("total_return") > 0).alias("profitable_periods"),
    )


# ---- sweeps and comparisons -----------------------------------------------------------------


def cross_parameters(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """Every row with every parameter row; the literal parameter table is broadcast and becomes part of the key."""
    return df.crossJoin(F.broadcast(parameters))


def threshold_table(spark: SparkSession, values: list[float], name: str = "threshold") -> DataFrame:
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


OBJECTIVES = {
    "most_trades": "total_trades", "best_win_rate": "win_rate", "best_return": "total_return_pct",
    "best_sharpe": "sharpe_ratio",
}


def best_per_objective(results: DataFrame, param: str, keys: list[str]) -> DataFrame:
    """Parameter value that is best for each objective; ties go to the smallest value."""
    best = [
        F.min_by(param, F.struct(-c(col).cast("double"), c(param))).alias(name) for name, col in OBJECTIVES.items()
    ]
    return results.groupBy(*keys).agg(*best)


def recommend(results: DataFrame, param: str, keys: list[str]) -> DataFrame:
    """Parameter with the best mix of scaled return (.4), win rate (.3) and Sharpe (.3)."""
    parts = {"total_return_pct": 0.4, "win_rate": 0.3, "sharpe_ratio": 0.3}
    bounds = results.groupBy(*keys).agg(
        *[f(n).alias(f"_{n}_{t}") for n in parts for t, f in (("lo", F.min), ("hi", F.max))]
    )
    score = sum(
        (c(n) - c(f"_{n}_lo")) / (c(f"_{n}_hi") - c(f"_{n}_lo") + 1e-6) * w for n, w in parts.items()
    )
    scored = results.join(bounds, keys).withColumn("score", score)
    return scored.groupBy(*keys).agg(
        F.min_by(param, F.struct(-c("score"), c(param))).alias("recommended"), F.max("score").alias("score")
    )


def best_profitable(results: DataFrame, param: str, keys: list[str]) -> DataFrame:
    """Highest Sharpe among profitable rows, else the row with most trades."""
    profitable = c("total_return_pct") > 0
    rank = F.struct(
        F.when(profitable, 0).otherwise(1),
        -F.when(profitable, c("sharpe_ratio")).otherwise(c("total_trades").cast("double")),
        c(param),
    )
    return results.groupBy(*keys).agg(F.min_by(param, rank).alias("best"), F.bool_or(profitable).alias("any_profitable"))


def compare_strategies(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Best strategy by Sharpe and by return, and how many are profitable."""
    best = lambda col: F.min_by("strategy", F.struct(-c(col), c("strategy")))
    return metrics.groupBy(*keys).agg(
        best("sharpe_ratio").alias("best_by_sharpe"),
        best("total_return_pct").alias("best_by_return"),
        F.count_if(c("total_return_pct") > 0).alias("profitable"),
        F.count(F.lit(1)).alias("strategies"),
    )


def verdict(metrics: DataFrame, buy_hold: str = "buy_hold_return") -> DataFrame:
    """Label a result against buy and hold."""
    ret, sharpe = c("total_return_pct"), c("sharpe_ratio")
    label = (
        F.when(c("total_trades") == 0, "NO TRADES")
        .when((ret > 100 * c(buy_hold)) & (sharpe > 1), "EXCELLENT")
        .when((ret > 0) & (c("win_rate") > 0.5), "GOOD")
        .when(ret > 0, "MARGINAL")
        .otherwise("POOR")
    )
    return metrics.withColumn("verdict", label)


def versus_buy_hold(metrics: DataFrame, buy_hold: DataFrame, keys: list[str]) -> DataFrame:
    df = metrics.join(buy_hold, keys)
    return df.withColumn("vs_buy_hold_pct", c("total_return_pct") - 100 * c("buy_hold_return"))


def paired_difference(results: DataFrame, left: str, right: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Column-wise ``left - right`` of two strategies on the same keys, by one grouping instead of a self join."""
    value = lambda who, n: F.max(F.when(c("strategy") == who, c(n)))
    return results.where(c("strategy").isin(left, right)).groupBy(*keys).agg(
        *[(value(left, n) - value(right, n)).alias(f"{n}_diff") for n in columns]
    )
