"""Model accuracy, feature drift and data quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.keytables import per_key
from candela.functions.guards import c, div
from candela.functions.quantiles import exact_percentiles, running_by_value
from candela.operators.evaluation import weighted_metrics

# ---- accuracy ------------------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series, shifted by eight."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def log_binomial(n: Column, k: Column, p: Column) -> Column:
    choose = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
    return choose + k * F.log(p) + (n - k) * F.log(1 - p)


def binomial_test(df: DataFrame, keys: list[str], n: str, k: str, p: Column) -> DataFrame:
    """Exact two-sided p-value of ``k`` hits in ``n``.

    Outcomes farther than 40 deviations from the mean are below the smallest
    double, so only those nearer are enumerated, as rows.
    """
    base = df.select(*keys, c(n).cast("double").alias("_n"), c(k).cast("double").alias("_k"), p.cast("double").alias("_p"))
    mean, reach = c("_n") * c("_p"), 40 * F.sqrt(c("_n") * c("_p") * (1 - c("_p"))) + 40
    lo = F.greatest(F.lit(0.0), F.least(F.floor(mean - reach), c("_k"))).cast("bigint")
    hi = F.least(c("_n"), F.greatest(F.ceil(mean + reach), c("_k"))).cast("bigint")
    terms = base.withColumn("_obs", log_binomial(c("_n"), c("_k"), c("_p"))).withColumn("_i", F.explode(F.sequence(lo, hi)))
    log_pmf = log_binomial(c("_n"), c("_i").cast("double"), c("_p"))
    likely = log_pmf <= c("_obs") + math.log1p(1e-7)
    return terms.groupBy(*keys).agg(
        F.least(F.lit(1.0), F.sum(F.when(likely, F.exp(log_pmf)).otherwise(0.0))).alias("p_value")
    )


def prediction_drift(predictions: DataFrame, order: str, prediction: str = "prediction") -> DataFrame:
    """|positive rate of the last 100 - rate of the 400 before|, 0 below 200 predictions. One row."""
    from pyspark.sql import Window

    newest = predictions.select(order, prediction).orderBy(F.desc(order)).limit(1000)  # top-k, not a full sort
    ranked = newest.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(order))))  # at most 1000 rows
    return ranked.agg(
        F.when(
            F.count(F.lit(1)) >= 200,
            F.abs(
                F.avg(F.when(c("_r") <= 100, c(prediction)))
                - F.avg(F.when((c("_r") > 100) & (c("_r") <= 500), c(prediction)))
            ),
        ).otherwise(0.0).alias("prediction_drift")
    )


def check_accuracy(
    labelled: DataFrame, order: str, label="label", prediction="prediction", baseline_accuracy=0.55,
    threshold=0.10, min_samples=30,
) -> DataFrame:
    """One-row report: accuracy, weighted F1, degradation, significance, drift, action and warnings."""
    stats = weighted_metrics(labelled, [], label, prediction)
    stats = stats.withColumn("_one", F.lit(1))
    test = binomial_test(stats, ["_one"], "samples", "correct", F.lit(baseline_accuracy))
    drift = prediction_drift(labelled, order, prediction).withColumn("_one", F.lit(1))
    df = stats.join(test, "_one").join(drift, "_one").drop("_one")
    loss = (baseline_accuracy - c("accuracy")) / baseline_accuracy
    df = df.withColumns(
        {
            "baseline_accuracy": F.lit(baseline_accuracy),
            "accuracy_degradation": loss,
            "significant": (c("samples") >= min_samples) & (c("p_value") < 0.05),
        }
    )
    loss, moved = c("accuracy_degradation"), c("prediction_drift")
    now, soon, watch = (loss > 0.15) | (moved > 0.3), (loss > 0.10) | (moved > 0.2), loss > 0.05
    pct = lambda x: F.format_string("%.1f%%", x * 100)
    notes = [
        F.when(loss > threshold, F.concat(F.lit("Accuracy degraded by "), pct(loss))),
        F.when(c("significant"), F.lit("Performance change is statistically significant")),
        F.when(moved > 0.2, F.concat(F.lit("Prediction distribution drift: "), pct(moved))),
    ]
    return df.withColumns(
        {
            "concept_drift_detected": c("significant") & (loss > 0.10),
            "needs_retraining": now | soon,
            "confidence_level": F.when(now, "low").when(soon | watch, "medium").otherwise("high"),
            "recommended_action": F.when(now, "retrain_immediately").when(soon, "schedule_retraining")
            .when(watch, "monitor_closely").otherwise("continue_monitoring"),
            "warnings": F.filter(F.array(*notes), lambda t: t.isNotNull()),
        }
    )


# ---- feature drift ----------------------------------------------------------------------


def long_features(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per feature value."""
    doubles = df.select(*keep, *[F.col(n).cast("double").alias(n) for n in features])
    return doubles.unpivot(list(keep), features, "feature", "value")


def feature_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, deviation, extremes and exact quartiles per feature."""
    values = long_features(df, features)
    basic = values.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    at = lambda p: F.max(F.when(c("prob") == p, c("value")))
    quartiles = exact_percentiles(values, ["feature"], "value", [0.25, 0.5, 0.75]).groupBy("feature").agg(
        at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75")
    )
    return basic.join(quartiles, "feature")


def psi(current: DataFrame, profile: DataFrame, features: list[str]) -> DataFrame:
    """Population stability index on the baseline's quartile bins; empty bins count as 0.0001."""
    df = long_features(current, features).where("value IS NOT NULL").join(
        per_key(profile.select("feature", "q25", "q50", "q75")), "feature"
    )
    v, a, b, z = c("value"), c("q25"), c("q50"), c("q75")
    bins = [v < a, (v >= a) & (v < b), (v >= b) & (v < z), v >= z]
    shares = df.groupBy("feature").agg(*[F.avg(cond.cast("double")).alias(f"_{i}") for i, cond in enumerate(bins)])
    floor = lambda i: F.when(c(f"_{i}") == 0, 0.0001).otherwise(c(f"_{i}"))
    total = sum(((floor(i) - 0.25) * F.log(floor(i) / 0.25) for i in range(4)), F.lit(0.0))
    return shares.select("feature", total.alias("psi"))


def ks_statistic(baseline: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic: the largest gap between the two distribution functions."""
    both = long_features(baseline, features).withColumn("_b", F.lit(1)).unionByName(
        long_features(current, features).withColumn("_b", F.lit(0))
    )
    steps = running_by_value(
        both.where("value IS NOT NULL"), ["feature"], "value",
        {"base": F.sum("_b"), "cur": F.sum(1 - c("_b"))},
    )
    # the running counts end at the totals, so a maximum gives them
    totals = steps.groupBy("feature").agg(F.max("base").alias("_nb"), F.max("cur").alias("_nc"))
    gap = F.abs(div("base", "_nb") - div("cur", "_nc"))
    return steps.join(totals, "feature").groupBy("feature").agg(F.max(gap).alias("ks"))


def drift_scores(baseline: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    return psi(current, feature_profile(baseline, features), features).join(
        ks_statistic(baseline, current, features), "feature"
    )


def drift_summary(scores: DataFrame, score: str = "psi", threshold: float = 0.15) -> DataFrame:
    """One row: mean of the ten highest scores, drifted features in descending order, flags.

    There is one score per feature, so the lists stay short.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-c(score)).alias("_o"), "feature")))
    df = scores.agg(ordered.alias("_all"), F.count(F.lit(1)).alias("total_features"))
    top = F.slice("_all", 1, 10)
    over = F.filter("_all", lambda x: -x["_o"] > threshold)
    mean = F.aggregate(top, F.lit(0.0), lambda s, x: s - x["_o"]) / F.nullif(F.size(top), F.lit(0))
    return df.select(
        F.coalesce(mean, F.lit(0.0)).alias("overall_drift_score"),
        F.transform(over, lambda x: x["feature"]).alias("drifted_features"),
        "total_features",
        F.size(over).cast("bigint").alias("features_drifted"),
    ).withColumn("needs_attention", c("overall_drift_score") > threshold)


# ---- data quality --------------------------------------------------------------------------


def column_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing share, deviation, share beyond five deviations, and flags.

    Two passes: one row of moments is joined back for the outlier count.
    """
    values = long_features(df, columns)
    moments = values.groupBy("feature").agg(
        F.avg(c("value").isNull().cast("double")).alias("missing_pct"), F.avg("value").alias("_m"),
        F.stddev_samp("value").alias("std"),
    )
    beyond = F.coalesce((c("std") > 0) & (F.abs(c("value") - c("_m")) > 5 * c("std")), F.lit(False))
    out = values.join(per_key(moments), "feature").groupBy("feature").agg(
        F.first("missing_pct").alias("missing_pct"), F.first("std").alias("std"),
        F.avg(beyond.cast("double")).alias("outlier_pct"),
    )
    return out.withColumns(
        {
            "high_missing": c("missing_pct") > 0.05,
            "constant": F.coalesce(c("std") == 0, F.lit(False)),
            "high_outliers": c("outlier_pct") > 0.01,
        }
    )


def missing_columns(spark: SparkSession, expected: list[str], actual: list[str]) -> DataFrame:
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "column string")
    return names(expected).exceptAll(names(actual))


def recency(df: DataFrame, ts: str, as_of: str, limit_days: int = 7) -> DataFrame:
    days = F.floor(F.timestamp_diff("SECOND", F.max(ts), F.lit(as_of).cast("timestamp_ntz")) / 86400)
    return df.agg(days.alias("days_since_update"), (days > limit_days).alias("stale"))


def quality_score(quality: DataFrame, missing: int = 0) -> DataFrame:
    """One row: score, mean missing share, number of constant columns, whether anything is wrong."""
    df = quality.agg(
        F.avg("missing_pct").alias("missing_pct"),
        F.count_if("constant").alias("constant_features"),
        F.bool_or(c("high_missing") | c("constant") | c("high_outliers")).alias("_bad"),
    )
    score = 1.0 - 0.1 * missing - F.least(c("missing_pct"), F.lit(0.3)) - 0.05 * c("constant_features")
    return df.select(
        F.greatest(F.lit(0.0), score).alias("quality_score"),
        "missing_pct",
        "constant_features",
        (c("_bad") | F.lit(missing > 0)).alias("has_issues"),
    )


def retrain_decision(
    accuracy: DataFrame, drift: DataFrame, quality: DataFrame, last_retrain: str | None, as_of: str,
    min_accuracy=0.45, max_drift=0.15, scheduled_days=30, min_days=7,
) -> DataFrame:
    """Should the model be trained again, and why; a cool-down and bad data veto it. All inputs have one row."""
    df = accuracy.crossJoin(F.broadcast(drift)).crossJoin(F.broadcast(quality))
    day = lambda s: F.lit(s).cast("date")
    since = F.datediff(day(as_of), day(last_retrain)) if last_retrain else F.lit(None).cast("int")
    pct = lambda x: F.format_string("%.1f%%", x * 100)
    acc, loss, moved = c("accuracy"), c("accuracy_degradation"), c("overall_drift_score")
    reasons = F.concat_ws(
        "; ",
        F.when(acc < min_accuracy, F.concat(F.lit("Accuracy below threshold: "), pct(acc), F.lit(f" < {min_accuracy:.1%}"))),
        F.when(loss > 0.15, F.concat(F.lit("Significant accuracy degradation: "), pct(loss))),
        F.when(moved > max_drift, F.concat(F.lit("High feature drift: "), F.format_string("%.2f", moved))),
        F.when(c("concept_drift_detected"), F.lit("Concept drift detected (significant performance change)")),
        F.when(since >= scheduled_days,
               F.concat(F.lit("Scheduled retraining ("), since.cast("string"), F.lit(" days since last retrain)"))),
    )
    some = F.length(reasons) > 0
    cooling = F.coalesce(some & (since < min_days), F.lit(False))
    poor = c("quality_score") < 0.7
    return df.select(
        (some & ~cooling & ~poor).alias("should_retrain"),
        F.when(cooling, F.concat(F.lit("Too soon to retrain (only "), since.cast("string"), F.lit(" days since last retrain)")))
        .when(poor, F.lit("Data quality too low for retraining"))
        .when(some, reasons).otherwise(F.lit("Model performing well, no retraining needed")).alias("reason"),
    )


def overall_status(accuracy: DataFrame, drift: DataFrame, quality: DataFrame) -> DataFrame:
    """CRITICAL, WARNING, MONITOR or HEALTHY with the parts as structs. All inputs have one row."""
    pack = lambda df, n: df.select(F.struct("*").alias(n))
    df = pack(accuracy, "model_health").crossJoin(F.broadcast(pack(drift, "drift_analysis"))).crossJoin(
        F.broadcast(pack(quality, "data_quality"))
    )
    loss, moved, q = (
        c("model_health.accuracy_degradation"), c("drift_analysis.overall_drift_score"), c("data_quality.quality_score")
    )
    status = (
        F.when((loss > 0.15) | (moved > 0.3) | (q < 0.5), "CRITICAL")
        .when((loss > 0.10) | (moved > 0.2) | (q < 0.7), "WARNING")
        .when(loss > 0.05, "MONITOR")
        .otherwise("HEALTHY")
    )
    return df.withColumn("overall_status", status)


def retrain_window(df: DataFrame, ts: str, as_of: str, days: int = 365) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where((c(ts) >= end - F.expr(f"INTERVAL {days} DAYS")) & (c(ts) <= end))
