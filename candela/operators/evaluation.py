"""Classifier evaluation, feature tables and comparisons, without fitting anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.keytables import per_key
from candela.functions.guards import c, div, div0
from candela.functions.quantiles import exact_percentiles, running_by_value
from candela.functions.series import RN, Series, index, strip


def confusion(df: DataFrame, keys: list[str], label="label", prediction="prediction") -> DataFrame:
    return df.groupBy(*keys, label, prediction).agg(F.count(F.lit(1)).alias("n"))


def weighted_metrics(df: DataFrame, keys: list[str], label="label", prediction="prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from the confusion counts."""
    cells = confusion(df, keys, label, prediction)
    # per class: hits, predicted and actual counts; a class is a row on both axes
    marks = cells.select(
        *keys,
        F.inline(
            F.array(
                F.struct(c(label).alias("cls"), F.when(c(label) == c(prediction), c("n")).otherwise(0).alias("hit"),
                         F.lit(0).cast("bigint").alias("said"), c("n").alias("real")),
                F.struct(c(prediction).alias("cls"), F.lit(0).cast("bigint").alias("hit"), c("n").alias("said"),
                         F.lit(0).cast("bigint").alias("real")),
            )
        ),
    )
    per = marks.groupBy(*keys, "cls").agg(F.sum("hit").alias("hit"), F.sum("said").alias("said"), F.sum("real").alias("real"))
    per = per.withColumns({"p": div0("hit", "said"), "r": div0("hit", "real")})
    per = per.withColumn("f", div0(2 * c("p") * c("r"), c("p") + c("r")))
    mean = lambda n: div0(F.sum(c(n) * c("real")), F.sum("real"))
    return per.groupBy(*keys).agg(
        F.sum("real").alias("samples"),
        F.sum("hit").alias("correct"),
        div(F.sum("hit"), F.sum("real")).alias("accuracy"),
        mean("p").alias("precision"),
        mean("r").alias("recall"),
        mean("f").alias("f1_score"),
    )


def binary_metrics(df: DataFrame, keys: list[str], label="label", prediction="prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where undefined."""
    hit, said, real = (
        F.count_if((c(label) == 1) & (c(prediction) == 1)), F.count_if(c(prediction) == 1), F.count_if(c(label) == 1)
    )
    out = df.groupBy(*keys).agg(
        F.avg((c(label) == c(prediction)).cast("double")).alias("accuracy"),
        div0(hit, said).alias("precision"),
        div0(hit, real).alias("recall"),
    )
    p, r = c("precision"), c("recall")
    return out.withColumn("f1_score", div0(2 * p * r, p + r))


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties at half, from running counts over distinct scores."""
    steps = running_by_value(
        df.where(c(score).isNotNull()), keys, score,
        {"neg": F.sum((c(label) == 0).cast("bigint")), "pos": F.sum((c(label) == 1).cast("bigint"))}, own=True,
    )
    below = c("neg") - c("neg_here")
    won = F.sum(c("pos_here") * (below + c("neg_here") * 0.5))
    return steps.groupBy(*keys).agg(div(won, F.sum("pos_here") * F.sum("neg_here")).alias("auc"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (k * count) per class; one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", div(c("_n"), c("_k") * c("n")).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    return df.join(class_weights(df, label).select(label, "weight"), label)


def class_distribution(df: DataFrame, label: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    both = counts.join(totals, keys) if keys else counts.crossJoin(F.broadcast(totals))
    return both.withColumn("share", div("n", "_t")).drop("_t")


# ---- features ------------------------------------------------------------------------


def feature_variances(df: DataFrame, features: list[str]) -> DataFrame:
    """Sample variance per feature from one aggregation, as rows."""
    return df.agg(*[F.var_samp(n).alias(n) for n in features]).unpivot([], features, "feature", "variance")


def top_features(scores: DataFrame, score: str, n: int) -> DataFrame:
    return scores.orderBy(F.desc(score), "feature").limit(n)


def importance_table(scores: DataFrame, score: str = "importance") -> DataFrame:
    """Rank, percent of the total and running percent. One row per feature, so the windows are small."""
    order = Window.orderBy(F.desc(score), "feature")
    everything = Window.partitionBy()
    pct = 100 * div0(c(score), F.sum(score).over(everything))
    return scores.select(
        "feature", score, F.row_number().over(order).alias("rank"), pct.alias("importance_pct"),
        F.sum(pct).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_pct"),
    )


def fit_scaler(df: DataFrame, features: list[str], method: str = "standard") -> DataFrame:
    """One row per feature with the offset and scale: population moments, or the range."""
    values = df.select(*[F.col(n).cast("double").alias(n) for n in features])
    lo, hi = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
    first = values.agg(*[lo(n).alias(n) for n in features]).unpivot([], features, "feature", "offset")
    second = values.agg(*[hi(n).alias(n) for n in features]).unpivot([], features, "feature", "_s")
    scale = c("_s") if method == "standard" else c("_s") - c("offset")
    return first.join(second, "feature").select("feature", "offset", F.when(scale == 0, 1.0).otherwise(scale).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """Scale the features; the scaler becomes one broadcast row."""
    pick = lambda name, col: F.max(F.when(c("feature") == name, c(col)))
    row = scaler.agg(*[pick(n, k).alias(f"_{k}_{n}") for n in features for k in ("offset", "scale")])
    joined = df.crossJoin(F.broadcast(row))
    scaled = {n: (c(n) - c(f"_offset_{n}")) / c(f"_scale_{n}") for n in features}
    return joined.withColumns(scaled).drop(*row.columns)


# Names that give the target away, and names that are prices.
LEAKS = ("future_return", "target_class", "target_binary", "target_regression")
NOT_FEATURES = ("open", "high", "low", "close", "volume")


def classify_columns(df: DataFrame, leaks=LEAKS, prices=NOT_FEATURES) -> DataFrame:
    """Each column's class: leak (contains a leaking name), non_feature, clean."""
    spark = df.sparkSession
    names = spark.createDataFrame([(n,) for n in df.columns], "column string")
    low = F.lower("column")
    leaking = F.lit(False)
    for leak in leaks:
        leaking = leaking | low.contains(leak.lower())
    return names.withColumn(
        "class", F.when(leaking, "leak").when(c("column").isin(*prices), "non_feature").otherwise("clean")
    )


def feature_names(df: DataFrame, also_exclude: tuple[str, ...] = ("symbol", "ts")) -> list[str]:
    return [n for n in df.columns if n not in {*NOT_FEATURES, *LEAKS, *also_exclude}]


# ---- splits ----------------------------------------------------------------------------


def chronological_split(df: DataFrame, series: Series, test_share: float = 0.2, validation_share: float = 0.0) -> DataFrame:
    """Mark the first rows of each series as train and the rest as test.

    A validation share is taken from the end of the train part.
    """
    keys = list(series.keys)
    lengths = per_key(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len")))
    numbered = index(df, series).join(lengths, keys)
    train = F.floor(c("_len") * (1 - test_share))
    inner = F.floor(train * (1 - validation_share))
    role = F.when(c(RN) <= inner, "train").when(c(RN) <= train, "validation").otherwise("test")
    return strip(numbered.withColumn("role", role).drop("_len"))


def expanding_folds(numbered: DataFrame, lengths: DataFrame, k: int = 5) -> DataFrame:
    """Copy rows into the k folds of an expanding split: test parts of n // (k + 1) rows, train before them."""
    keys = [n for n in lengths.columns if n != "n"]
    df = numbered.join(per_key(lengths), keys).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    size = F.expr(f"n div {k + 1}")
    start = c("n") - (k + 1 - c("fold")) * size
    role = F.when(c("rn") <= start, "train").when(c("rn") <= start + size, "test")
    return df.withColumn("role", role).where("role IS NOT NULL").drop("n")


# ---- probability tables --------------------------------------------------------------------


def probability_summary(df: DataFrame, keys: list[str], prob: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles."""
    basic = df.groupBy(*keys).agg(
        F.count(prob).alias("n"), F.avg(prob).alias("mean"), F.stddev_samp(prob).alias("std"),
        F.min(prob).alias("min"), F.max(prob).alias("max"),
    )
    at = lambda p: F.max(F.when(c("prob") == p, c("value")))
    q = exact_percentiles(df, keys, prob, [0.25, 0.5, 0.75]).groupBy(*keys).agg(
        at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75")
    )
    return basic.join(q, keys) if keys else basic.crossJoin(F.broadcast(q))


def prediction_table(scored: DataFrame, prob: str = "prob_up", day: str = "ts") -> DataFrame:
    up = c(prob) > 0.5
    return scored.select(
        "symbol", F.col(day), (1 - c(prob)).alias("prob_sell"), c(prob).alias("prob_buy"), up.cast("int").alias("predicted_class"),
        F.when(up, "BUY").otherwise("SELL").alias("predicted_label"),
    )


def extremes(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The n highest and n lowest rows."""
    top = df.orderBy(F.desc(by), tie).limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(df.orderBy(F.asc(by), tie).limit(n).withColumn("end", F.lit("bottom")))


def threshold_counts(df: DataFrame, keys: list[str], prob: Column, thresholds: list[float]) -> DataFrame:
    """Rows at or above each threshold, in one pass."""
    return df.groupBy(*keys).agg(
        *[F.count_if(prob >= t).alias(f"at_{int(round(t * 100))}") for t in thresholds]
    )


def metric_deltas(metrics: DataFrame, before: str, after: str, columns: list[str], name: str = "model") -> DataFrame:
    """``after - before`` of two named rows, as one row."""
    value = lambda who, n: F.max(F.when(c(name) == who, c(n)))
    return metrics.agg(*[(value(after, n) - value(before, n)).alias(f"{n}_delta") for n in columns])
