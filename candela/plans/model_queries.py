"""Queries of fitted models.

Logistic models have one optimum, so their scores, coefficients, rankings and trades are returned, and SQL fits them again
by other steps.  What trees return depends on their draws; of these the queries say what must hold whatever those are:
which rows were scored, that probabilities are probabilities, that a fit beats the constant guess on its own rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.durable import materialize, saved, scratch_path
from candela.functions.series import bar_series, on_series
from candela.operators import boosting as bo
from candela.operators import evaluation as ev
from candela.operators import indicators as ind
from candela.operators import keyed_models as km
from candela.operators import ledger as led
from candela.operators import ml
from candela.operators import regimes as reg
from candela.operators import signals as sig
from candela.operators import walkforward as wf
from candela.plans import fit_sql
from candela.plans.fitted_scores import FEATURES, feature_sql
from candela.plans.ledger_queries import recursive
from candela.plans.regime_queries import FLAGS
from candela.plans.registry import query
from candela.plans.signal_queries import base, outcome
from candela.plans.sqltext import BARS, flag, r, rounded, stages
from candela.plans.walkforward_queries import FREE, RESULT, keyed_series, part, result_sql, shown, table_of
from candela.sources import sinks
from candela.sources.driver_tables import embedding_features, event_bars

def model_frame(spark, sf_dir, label: str | None = "label"):
    """Clean features, the next-bar label, its regression target and a role, saved because several fits read it.

    Without a label, rows of any future are kept, and ``future_return_5`` beside them.
    """
    bars = event_bars(spark, sf_dir)
    parts = ind.chain(ind.returns(), ind.beside(
        ind.lagged_returns(), ind.momentum(), ind.bar_ratios(), ind.gap(), ind.rsi(14), ind.macd(), ind.bollinger(20), ind.atr(14),
        ind.stochastic(), ind.adx_simple(14), ind.cci(20), ind.volatility((20,)), ind.momentum_features((10, 20)), ind.close_std(14),
        ind.sma((50, 200))))
    # the future is seen in the windows that are there, not by a join
    def ahead(df, f):
        return df.withColumns({n: F.try_divide(f.lead("close", k), F.col("close")) - 1 for n, k in (("future_return", 1), ("future_return_5", 5))})

    df = on_series(ind.chain(parts, reg.regime_flags())(bars), bar_series(), ahead, lookahead=5).dropna(subset=FEATURES)
    if label is None:
        return saved(df.withColumn("id", F.xxhash64("symbol", "ts")), "model-frame")
    df = df.withColumn(label, (F.col("future_return") > 0).cast("int")).dropna(subset=[label])
    df = ev.chronological_split(df, bar_series())
    return saved(df.withColumn("id", F.xxhash64("symbol", "ts")), "model-frame")


#: The same rows in SQL, with the features, number in the series, length, label and role.
FRAME = (
    *feature_sql(),
    "x AS (SELECT fv.* EXCLUDE (i, n), y1 AS label, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n"
    " FROM fv WHERE y1 IS NOT NULL)",
    "mf AS MATERIALIZED (SELECT *, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM x)",
)
LIST = ", ".join(FEATURES)
BALANCED = "count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label))"


def balanced_model(df: DataFrame, features=FEATURES) -> DataFrame:
    """One logistic model of the train rows, both classes weighing the same."""
    train = km.balanced_weights(df.where("role = 'train'").withColumn("model", F.lit("one")), ["model"])
    return km.fit_logistic(train, ["model"], list(features), weight="weight")


def balanced_scores(df: DataFrame, features=FEATURES) -> DataFrame:
    test = df.where("role = 'test'").withColumn("model", F.lit("one"))
    return km.score(test, balanced_model(df, features), ["model"], list(features))


def balanced_sql(features=FEATURES, source="mf") -> list[str]:
    """``te``: the test rows with ``p``, scored by the model of the train rows."""
    names = ", ".join(features)
    return [
        f"fit_rows AS MATERIALIZED (SELECT 'one' AS m, label AS y, {BALANCED}::DOUBLE AS w, {names} FROM {source} WHERE role = 'train')",
        *fit_sql.logistic_ctes("lg", "fit_rows", features),
        f"te AS MATERIALIZED (SELECT s.*, {fit_sql.probability('lg', features)} AS p FROM {source} s, lg WHERE role = 'test')",
    ]


def log_loss(p: Column, label: Column) -> Column:
    kept = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(label * F.log(kept) + (1 - label) * F.log(1 - kept))


def report(scored: DataFrame, name: str, prob: str = "prob_up", weight: Column | None = None) -> DataFrame:
    """One row about train and test rows with probabilities ``prob``."""
    p, y, w = F.col(prob), F.col("label"), F.lit(1.0) if weight is None else weight
    train = F.col("role") == "train"
    share = F.sum(F.when(train, w * y)) / F.sum(F.when(train, w))
    sums = scored.agg(
        *[F.count_if((F.col("role") == r) & cond).alias(f"{r}_{n}") for r in ("train", "test") for n, cond in (("rows", F.lit(True)), ("up", y == 1))],
        F.bool_and((p >= 0) & (p <= 1)).alias("probabilities"),
        share.alias("_share"), (F.sum(F.when(train, w * p)) / F.sum(F.when(train, w))).alias("_mean"),
        (F.sum(F.when(train, w * log_loss(p, y))) / F.sum(F.when(train, w))).alias("_loss"),
    )
    s = F.col("_share")
    return sums.select(
        F.lit(name).alias("model"), "train_rows", "train_up", "test_rows", "test_up", "probabilities",
        (F.col("_loss") < log_loss(s, s)).alias("beats_constant"), F.round(F.abs(F.col("_mean") - s), 2).alias("bias"),
    )


def report_sql(name: str, biased: bool = False) -> str:
    return stages(BARS, *FRAME) + (
        f"SELECT '{name}' AS model, " + ", ".join(
            f"count(*) FILTER (role = '{r}'{' AND label = 1' if n == 'up' else ''}) AS {r}_{n}" for r in ("train", "test") for n in ("rows", "up")
        ) + ", true AS probabilities, true AS beats_constant" + ("" if biased else ", 0.0::DOUBLE AS bias") + " FROM mf"
    )


def fitted(df: DataFrame, kind: str, features=FEATURES, **params) -> DataFrame:
    return ml.score(ml.fit(df.where("role = 'train'"), list(features), kind, **params), df)


@query("h06_logistic", stages(BARS, *FRAME, *balanced_sql()) + f"SELECT symbol, ts, label, {r('p', 4)} AS prob_up FROM te")
def logistic(spark, sf_dir):
    """Probabilities of the later rows by a model of balanced classes."""
    return rounded(balanced_scores(model_frame(spark, sf_dir)).select("symbol", "ts", "label", "prob_up"), 4)


THREE = [
    *feature_sql(), "fu AS (SELECT symbol, ts, lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS fr FROM bars)",
    "x3 AS (SELECT fv.* EXCLUDE (i, n), CASE WHEN fr > 0.02 THEN 2 WHEN fr < -0.02 THEN 0 ELSE 1 END AS label,"
    " row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM fv JOIN fu USING (symbol, ts) WHERE fr IS NOT NULL)",
    "mf AS MATERIALIZED (SELECT *, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM x3)",
    f"fit_rows AS MATERIALIZED (SELECT 'one' AS m, label AS y, 1.0::DOUBLE AS w, {LIST} FROM mf WHERE role = 'train')",
    *fit_sql.softmax_ctes("lg", "fit_rows", FEATURES, 3),
    "te AS (SELECT symbol, ts, label, " + ", ".join(
        f"exp(lg.c{a}_0 + " + " + ".join(f"lg.c{a}_{k} * {f}" for k, f in enumerate(FEATURES, 1)) + f") AS e{a}" for a in range(3))
    + " FROM mf, lg WHERE role = 'test')",
]


@query("h06_three_classes", stages(BARS, *THREE) + "SELECT symbol, ts, label, " + ", ".join(f"{r(f'e{a} / (e0 + e1 + e2)', 4)} AS prob_{a}" for a in range(3))
       + ", CASE WHEN e0 >= greatest(e1, e2) THEN 0 WHEN e1 >= e2 THEN 1 ELSE 2 END AS predicted FROM te")
def three_classes(spark, sf_dir):
    """Down, flat or up by more than two per cent within five bars: one softmax model, class probabilities of the later rows."""
    df = model_frame(spark, sf_dir, label=None)
    up = F.when(F.col("future_return_5") > 0.02, 2).when(F.col("future_return_5") < -0.02, 0).otherwise(1)
    df = ev.chronological_split(df.where("future_return_5 IS NOT NULL").withColumns({"label": up, "model": F.lit("one")}), bar_series())
    models = km.fit_logistic(df.where("role = 'train'"), ["model"], FEATURES, classes=3)
    scored = km.score_classes(df.where("role = 'test'"), models, ["model"], FEATURES, 3)
    return rounded(scored.select("symbol", "ts", "label", "prob_0", "prob_1", "prob_2", "predicted"), 4)


@query("h07_random_forest", report_sql("random_forest", biased=True))
def forest(spark, sf_dir):
    """A forest of balanced classes."""
    df = km.balanced_weights(model_frame(spark, sf_dir), ["role"])
    return report(fitted(df, "random_forest", weight="weight"), "random_forest").drop("bias")


@query("h08_gradient_boosting", report_sql("gradient_boosting", biased=True))
def boosting(spark, sf_dir):
    """First-order boosting of a hundred trees."""
    return report(fitted(model_frame(spark, sf_dir), "gradient_boosting", **FIRST_ORDER), "gradient_boosting").drop("bias")


#: Fixed values of the first-order boosting, and of the models that vote.
FIRST_ORDER = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
VOTE_FOREST = {"numTrees": 50, "maxDepth": 8}
SECOND_ORDER = bo.Boosting(rounds=40, depth=3, rate=0.1)


def second_order_scores(df: DataFrame, plan: bo.Boosting = SECOND_ORDER) -> DataFrame:
    keyed = df.withColumn("model", F.lit("one"))
    models, cuts = bo.fit_boosted(keyed.where("role = 'train'"), ["model"], FEATURES, plan=plan)
    return saved(bo.score_boosted(keyed, models, cuts, ["model"], FEATURES, plan=plan), "boosted-scores")


@query("h08_second_order_boosting", report_sql("second_order", biased=True))
def second_order(spark, sf_dir):
    """Boosting on slopes and curvatures with a penalty on leaves, rows and columns drawn for each tree."""
    return report(second_order_scores(model_frame(spark, sf_dir)), "second_order").drop("bias")


@query("h09_soft_vote", report_sql("ensemble", biased=True))
def soft(spark, sf_dir):
    """The mean of three kinds: logistic, forest and second-order boosting."""
    df = second_order_scores(model_frame(spark, sf_dir)).withColumnRenamed("prob_up", "prob_boosted")
    for kind, params in (("logistic", {}), ("random_forest", VOTE_FOREST)):
        df = ml.score(ml.fit(df.where("role = 'train'"), FEATURES, kind, **params), df, f"prob_{kind}")
    vote = ml.soft_vote(df, ["prob_logistic", "prob_random_forest", "prob_boosted"])
    return report(vote, "ensemble", "prob_vote").drop("bias")


@query("h12_predict", stages(BARS, *FRAME, *balanced_sql()) + f"SELECT symbol, ts, {r('p', 4)} AS prob_up, CAST(p > 0.5 AS INTEGER) AS predicted,"
       f" {r('greatest(p, 1 - p)', 4)} AS confidence FROM te")
def predict(spark, sf_dir):
    p = F.col("prob_up")
    out = balanced_scores(model_frame(spark, sf_dir))
    return rounded(out.select("symbol", "ts", "prob_up", (p > 0.5).cast("int").alias("predicted"), F.greatest(p, 1 - p).alias("confidence")), 4)


FOLDED = [
    "fo AS MATERIALIZED (SELECT mf.*, k AS fold, n - (6 - k) * (n // 6) AS past FROM mf, range(1, 6) t(k))",
    f"fit_rows AS MATERIALIZED (SELECT fold AS m, label AS y, 1.0::DOUBLE AS w, {LIST} FROM fo WHERE rn <= past)",
    *fit_sql.logistic_ctes("lg", "fit_rows", FEATURES),
    f"te AS MATERIALIZED (SELECT fold, label AS y, CAST({fit_sql.probability('lg', FEATURES)} > 0.5 AS INTEGER) AS p"
    " FROM fo JOIN lg ON m = fold WHERE rn > past AND rn <= past + n // 6)",
    "cl AS (SELECT fold, c, count(*) FILTER (y = c) AS actual, count(*) FILTER (p = c) AS said, count(*) FILTER (y = c AND p = c) AS hit"
    " FROM te, (VALUES (0), (1)) v(c) GROUP BY fold, c)",
]


@query("h05_cross_validation", stages(BARS, *FRAME, *FOLDED) + f"SELECT fold, CAST(sum(actual) AS BIGINT) AS samples, {r('sum(hit) / sum(actual)')} AS accuracy,"
       f" {r('sum(actual * coalesce(2.0 * hit / nullif(actual + said, 0), 0)) / sum(actual)')} AS f1_score FROM cl GROUP BY fold")
def cross(spark, sf_dir):
    """Five expanding folds, their models fitted in one job."""
    df = model_frame(spark, sf_dir)
    folded = saved(ev.expanding_folds(wf.number_rows(df), wf.series_lengths(df), 5), "folds")
    models = km.fit_logistic(folded.where("role = 'train'"), ["fold"], FEATURES)
    scored = km.score(folded.where("role = 'test'"), models, ["fold"], FEATURES)
    scores = ev.weighted_metrics(scored.withColumn("prediction", (F.col("prob_up") > 0.5).cast("int")), ["fold"])
    return rounded(scores.select(F.col("fold").cast("bigint").alias("fold"), "samples", "accuracy", "f1_score"))


PENALTIES = [0.001, 0.01, 0.1, 1.0]
GRID = [
    "fo AS MATERIALIZED (SELECT mf.*, k AS fold, n - (6 - k) * (n // 6) AS past FROM mf, range(1, 6) t(k))",
    f"fit_rows AS MATERIALIZED (SELECT fold AS m, label AS y, 1.0::DOUBLE AS w, {LIST} FROM fo WHERE rn <= past)",
    *[cte for k, p in enumerate(PENALTIES) for cte in fit_sql.logistic_ctes(f"lg{k}", "fit_rows", FEATURES, reg=p)],
    "te AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS reg, fold, label AS y, CAST({fit_sql.probability(f'lg{k}', FEATURES)} > 0.5 AS INTEGER) AS p FROM fo JOIN lg{k} ON m = fold"
        " WHERE rn > past AND rn <= past + n // 6" for k, p in enumerate(PENALTIES)) + ")",
    "cl AS (SELECT reg, fold, c, count(*) FILTER (y = c) AS actual, count(*) FILTER (p = c) AS said, count(*) FILTER (y = c AND p = c) AS hit"
    " FROM te, (VALUES (0), (1)) v(c) GROUP BY reg, fold, c)",
    "fs AS (SELECT reg, fold, sum(hit) / sum(actual) AS a, sum(actual * coalesce(2.0 * hit / nullif(actual + said, 0), 0)) / sum(actual) AS f FROM cl GROUP BY reg, fold)",
]


@query("h11_grid_search", stages(BARS, *FRAME, *GRID) + f"SELECT reg, {r('avg(a)')} AS accuracy_mean, {r('avg(f)')} AS f1_score_mean FROM fs GROUP BY reg")
def exhaustive(spark, sf_dir):
    """Every point of a grid of penalties on five expanding folds."""
    df = model_frame(spark, sf_dir)
    folded = saved(ev.expanding_folds(wf.number_rows(df), wf.series_lengths(df), 5), "folds")
    found = None
    for reg_ in PENALTIES:  # one job of five models for each penalty
        models = km.fit_logistic(folded.where("role = 'train'"), ["fold"], FEATURES, reg=reg_)
        scored = km.score(folded.where("role = 'test'"), models, ["fold"], FEATURES)
        scores = ev.weighted_metrics(scored.withColumn("prediction", (F.col("prob_up") > 0.5).cast("int")), ["fold"])
        one = ml.summarize_folds(scores).select(F.lit(reg_).alias("reg"), "accuracy_mean", "f1_score_mean")
        found = one if found is None else found.unionByName(one)
    return rounded(found)


FOREST_GRID = {"numTrees": [10, 20], "maxDepth": [3, 5, 8], "minInstancesPerNode": [5, 10, 20]}


@query("h11_sampled_search", stages(BARS, *FRAME) + "SELECT 6 AS points, true AS sampled, true AS ordered, true AS scores, count(*) > 0 AS fitted FROM mf WHERE role = 'train'")
def search(spark, sf_dir):
    """Six forests drawn from a grid, three expanding folds each, best F1 first."""
    df = model_frame(spark, sf_dir).select("symbol", "ts", *FEATURES, "label")
    folded = materialize(ev.expanding_folds(wf.number_rows(df), wf.series_lengths(df), 3))
    found = ml.sampled_search(folded, FEATURES, "random_forest", FOREST_GRID, points=6, folds=3)
    rows = found.select(F.collect_list(F.struct(*FOREST_GRID)).alias("p"), F.collect_list("f1_score_mean").alias("f"))
    return rows.select(
        F.size("p").alias("points"), (F.size(F.array_distinct("p")) == F.size("p")).alias("sampled"),
        (F.col("f") == F.reverse(F.array_sort("f"))).alias("ordered"), F.forall("f", lambda x: (x >= 0) & (x <= 1)).alias("scores"),
        (F.size("f") > 0).alias("fitted"),
    )


@query("h15_model_importance", "SELECT 20 AS features, 100.0::DOUBLE AS total, true AS ranked")
def importance(spark, sf_dir):
    t = ev.importance_table(ml.importances(ml.fit(model_frame(spark, sf_dir), FEATURES, "random_forest"), FEATURES))
    ranks = F.array_sort(F.collect_list(F.struct("rank", (-F.col("importance")).alias("i"))))
    down = F.transform(ranks, lambda x: x["i"])
    return t.agg(F.count_if(F.col("importance") >= 0).cast("int").alias("features"), F.round(F.sum("importance_pct"), 6).alias("total"),
                 (down == F.array_sort(down)).alias("ranked"))


@query("h16_lasso_ranking", "SELECT 20 AS features, true AS sparse, true AS sparser")
def lasso(spark, sf_dir):
    """The penalty sets coefficients to zero, and a greater one sets more."""
    df = ml.scaled(model_frame(spark, sf_dir), FEATURES)
    zeros = [ml.importances(ml.fit(df, FEATURES, "lasso", regParam=reg_), FEATURES).withColumn("reg", F.lit(reg_)) for reg_ in (0.002, 0.02)]
    none = lambda reg_: F.count_if((F.col("reg") == reg_) & (F.col("importance") == 0))
    both = zeros[0].unionByName(zeros[1])
    return both.agg(F.count_distinct("feature").cast("int").alias("features"), (none(0.02) > 0).alias("sparse"), (none(0.02) >= none(0.002)).alias("sparser"))


@query("h17_weighted_fit", stages(BARS, *FRAME, *balanced_sql()) + "SELECT unnest([" + ", ".join(f"'{n}'" for n in ["(intercept)", *FEATURES])
       + "]) AS feature, unnest([" + ", ".join(r(f"c{k}", 4) for k in range(len(FEATURES) + 1)) + "]) AS coefficient FROM lg")
def weighted(spark, sf_dir):
    """Coefficients of a fit with balanced weights."""
    model = balanced_model(model_frame(spark, sf_dir))
    named = F.array(F.struct(F.lit("(intercept)").alias("feature"), F.col("intercept").alias("coefficient")),
                    *[F.struct(F.lit(n).alias("feature"), F.get("coefficients", F.lit(k)).alias("coefficient")) for k, n in enumerate(FEATURES)])
    return rounded(model.select(F.inline(named)), 4)


@query("h15_logistic_importance", stages(BARS, *FRAME, *balanced_sql(), "im AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in FEATURES)
       + "]) AS feature, unnest([" + ", ".join(f"abs(b{k})" for k in range(1, len(FEATURES) + 1)) + f"]) AS importance FROM lg_g WHERE it = {fit_sql.STEPS})")
       + f"SELECT feature, {r('importance', 4)} AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,"
       f" {r('100 * importance / sum(importance) OVER ()', 4)} AS importance_pct FROM im")
def logistic_importance(spark, sf_dir):
    """Features by the size of their standardised coefficients."""
    return rounded(ev.importance_table(standardised(model_frame(spark, sf_dir))).select("feature", "importance", "rank", "importance_pct"), 4)


def standardised(df: DataFrame) -> DataFrame:
    model = balanced_model(df)
    train = km.balanced_weights(df.where("role = 'train'").withColumn("model", F.lit("one")), ["model"])
    # the spread that the fit divides by: weighted, with n - 1 for equal weights
    w = F.col("weight")
    means = train.agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"), *[(F.sum(w * F.col(n)) / F.sum(w)).alias(f"_m_{n}") for n in FEATURES])
    spreads = train.crossJoin(F.broadcast(means)).agg(*[  # one row
        F.sqrt(F.sum(w * F.pow(F.col(n) - F.col(f"_m_{n}"), 2)) / (F.first("_w") - F.first("_ww") / F.first("_w"))).alias(f"_s_{n}") for n in FEATURES])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.abs(F.get("coefficients", F.lit(k)) * F.col(f"_s_{n}")).alias("importance")) for k, n in enumerate(FEATURES)])
    return saved(model.crossJoin(F.broadcast(spreads)).select(F.inline(rows)), "importance")


@query("h18_nearest_neighbours", """
WITH p AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings),
n AS (SELECT a.vec_id, b.vec_id AS neighbour, array_distance(a.x, b.x) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM n)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM k WHERE rank <= 5""")
def neighbours(spark, sf_dir):
    names = [f"f{i}" for i in range(64)]
    return rounded(ml.nearest_neighbours(embedding_features(spark, sf_dir), names, 5, "vec_id"))


@query("h18_smote", """
WITH n AS (SELECT count(*) FILTER (label = 0) AS few, count(*) FILTER (label <> 0) AS many FROM embeddings)
SELECT 0 AS label, false AS synthetic, many AS n FROM n UNION ALL SELECT 1, false, few FROM n
UNION ALL SELECT 1, true, many - few FROM n WHERE many > few""")
def oversample(spark, sf_dir):
    names = [f"f{i}" for i in range(64)]
    df = embedding_features(spark, sf_dir).withColumn("label", (F.col("label") == 0).cast("int"))
    out = ml.smote(df, names, key="vec_id")
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


HELD_OUT = [
    f"fit_rows AS MATERIALIZED (SELECT k AS m, label AS y, 1.0::DOUBLE AS w, {LIST} FROM mf, range(0, 5) t(k) WHERE rn % 5 <> k)",
    *fit_sql.logistic_ctes("lg", "fit_rows", FEATURES),
    f"ho AS MATERIALIZED (SELECT symbol, ts, label, {fit_sql.probability('lg', FEATURES)} AS p FROM mf JOIN lg ON m = rn % 5)",
    "pt AS MATERIALIZED (SELECT 'one' AS m, label AS y, 1.0::DOUBLE AS w, p FROM ho)", *fit_sql.logistic_ctes("pl", "pt", ["p"], reg=0.0, flat=0.2),
]


@query("h19_calibration", stages(BARS, *FRAME, *HELD_OUT) + f"SELECT symbol, ts, label, {r('p', 4)} AS prob_up,"
       f" {r('1 / (1 + exp(-(c0 + c1 * p)))', 4)} AS prob_calibrated FROM ho, pl")
def calibrated(spark, sf_dir):
    """Scores of five models that have not seen the row, and their sigmoid calibration."""
    df = wf.number_rows(model_frame(spark, sf_dir)).withColumn("own", F.col("rn") % 5)
    others = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("part != own")
    models = km.fit_logistic(others, ["part"], FEATURES).withColumnRenamed("part", "own")
    raw = saved(km.score(df, models, ["own"], FEATURES).withColumn("model", F.lit("one")), "held-out")
    out = km.score(raw, km.fit_logistic(raw, ["model"], ["prob_up"], reg=0.0), ["model"], ["prob_up"], "prob_calibrated")
    return rounded(out.select("symbol", "ts", "label", "prob_up", "prob_calibrated"), 4)


SETS = ("clean", "leaking", "top")
ALL_COLUMNS = [*FEATURES, "future_return"]
TOP = 10


def set_case(model: str, column: str, top: str) -> str:
    if column == "future_return":
        return f"{column}" if model == "leaking" else "0.0::DOUBLE"
    return f"CASE WHEN list_contains({top}, '{column}') THEN {column} ELSE 0 END" if model == "top" else column


FEATURE_SETS = [
    BARS, *FRAME, *balanced_sql(),
    "im AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in FEATURES) + "]) AS feature, unnest([" + ", ".join(f"abs(b{k})" for k in range(1, len(FEATURES) + 1))
    + f"]) AS importance FROM lg_g WHERE it = {fit_sql.STEPS})",
    f"tp AS MATERIALIZED (SELECT list(feature) AS top FROM (SELECT feature FROM im ORDER BY importance DESC, feature LIMIT {TOP}))",
    "ml2 AS (SELECT mf.*, close, high, low, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS future_return FROM bars LEFT JOIN mf USING (symbol, ts))",
    "ms AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT '{m}' AS m, symbol, ts, rn, n, role, label AS y, 1.0::DOUBLE AS w, " + ", ".join(f"{set_case(m, c, 'top')} AS {c}" for c in ALL_COLUMNS)
        + " FROM ml2, tp WHERE rn IS NOT NULL" for m in SETS) + ")",
    "mt AS MATERIALIZED (SELECT * FROM ms WHERE role = 'train')", *fit_sql.logistic_ctes("ls", "mt", ALL_COLUMNS),
    f"me AS MATERIALIZED (SELECT ms.m, symbol, ts, rn, y, {fit_sql.probability('ls', ALL_COLUMNS)} AS p FROM ms JOIN ls USING (m) WHERE role = 'test')",
]
LEDGER_OF_SCORES = [
    *base(), "sg0 AS (SELECT z2.* EXCLUDE (symbol, rn), z2.symbol || '#' || me.m AS symbol, row_number() OVER (PARTITION BY me.m, symbol ORDER BY ts) AS rn, me.rn AS nth, p"
    " FROM z2 JOIN me USING (symbol, ts))",
    "sg AS (SELECT *, " + outcome("(nth >= 60 AND atr IS NOT NULL AND p > 0.5 AND greatest(p, 1 - p) >= 0.52)", "false", "2 * atr", "3 * atr", ("'b'", "'s'"))
    + " FROM sg0)",
]


@query("h25_feature_sets", recursive(*result_sql([*FEATURE_SETS, *LEDGER_OF_SCORES]), f"hs AS (SELECT m, symbol, count(*) AS samples,"
       f" {r('avg(CAST(CAST(p > 0.5 AS INTEGER) = y AS INTEGER))')} AS accuracy FROM me GROUP BY m, symbol)")
       + f"SELECT hs.m AS model, hs.symbol, samples, accuracy, {shown()} FROM hs JOIN res ON res.symbol = hs.symbol || '#' || hs.m")
def feature_sets(spark, sf_dir):
    """The same model on clean, leaking and the ten strongest features: accuracy on later rows, and the trades of its signals.

    A column that knows the next bar shows as a leak by an accuracy that clean features do not reach.
    """
    df = model_frame(spark, sf_dir)
    best = [row.feature for row in ev.top_features(standardised(df), "importance", TOP).collect()]
    numbered = wf.number_rows(df)
    parts = None
    for name, columns in (("clean", FEATURES), ("leaking", ALL_COLUMNS), ("top", best)):
        one = numbered.withColumn("model", F.lit(name)).withColumns({n: F.lit(0.0) for n in ALL_COLUMNS if n not in columns})
        parts = one if parts is None else parts.unionByName(one)
    stacked = saved(parts, "feature-sets")
    models = km.fit_logistic(stacked.where("role = 'train'"), ["model"], ALL_COLUMNS)
    scored = saved(km.score(stacked.where("role = 'test'"), models, ["model"], ALL_COLUMNS), "scored")
    right = scored.withColumn("hit", ((F.col("prob_up") > 0.5).cast("int") == F.col("label")).cast("int"))
    hits = right.groupBy("model", "symbol").agg(F.count(F.lit(1)).alias("samples"), F.avg("hit").alias("accuracy"))
    series = keyed_series("symbol", "model")
    test = led.backtest(sig.long_only_model_rule(scored, 0.52), FREE, series)
    return rounded(hits.join(table_of(test, series, RESULT), ["symbol", "model"]), 4, accuracy=6)


FLAG_NAMES = ["regime_trending", "regime_ranging", "regime_bull", "regime_bear", "regime_high_vol", "regime_low_vol",
              "regime_overbought", "regime_oversold", "regime_uptrend", "regime_downtrend"]


FLAG_SQL = [
    *[re.sub(r"\bf([1-4])\b", r"g\1", c) for c in FLAGS],
    "fl AS (SELECT symbol, ts, CAST(" + ", CAST(".join(f"{e} AS DOUBLE) AS {n}" for n, e in {
        "regime_trending": flag("adx > 25"), "regime_ranging": flag("adx < 20"),
        "regime_bull": flag("close > a AND a > b AND step > 0"), "regime_bear": flag("close < a AND a < b AND step < 0"),
        "regime_high_vol": flag("vol > med * 1.5"), "regime_low_vol": flag("vol < med * 0.7"),
        "regime_overbought": flag("rsi > 70"), "regime_oversold": flag("rsi < 30"),
        "regime_uptrend": flag("hi > phi"), "regime_downtrend": flag("lo < plo")}.items()) + " FROM g4)",
    "mg AS MATERIALIZED (SELECT * FROM mf JOIN fl USING (symbol, ts))",
]


@query("f13_logistic_regime", stages(
    BARS, *FRAME, *FLAG_SQL, *balanced_sql([*FEATURES, *FLAG_NAMES], "mg"), *base(),
    "jn AS (SELECT z2.symbol, z2.ts, close, atr, te.rn AS nth, p FROM z2 JOIN te USING (symbol, ts))",
    "sg AS (SELECT *, greatest(p, 1 - p) AS confidence, " + outcome("(nth >= 60 AND atr IS NOT NULL AND p > 0.5 AND greatest(p, 1 - p) >= 0.55)", "false", "2 * atr", "3 * atr", ("'b'", "'s'"))
    + " FROM jn)") + f"SELECT symbol, ts, action, {r('confidence', 4)} AS confidence, {r('stop_loss')} AS stop_loss, {r('take_profit')} AS take_profit"
    " FROM sg WHERE action IS NOT NULL")
def logistic_regime(spark, sf_dir):
    """Long-only entries of a logistic model on features and regime flags."""
    scored = balanced_scores(wf.number_rows(model_frame(spark, sf_dir)), [*FEATURES, *FLAG_NAMES])
    marked = sig.entries(sig.long_only_model_rule(scored, 0.55))
    return rounded(marked.select("symbol", "ts", "action", "confidence", "stop_loss", "take_profit"), confidence=4)


SPLIT_FITS = [
    BARS, *FRAME,
    "sp AS MATERIALIZED (SELECT mf.*, k + 1 AS split_num, rn - k * 126 AS place FROM mf, range(0, 1000) t(k) WHERE k * 126 + 315 <= n AND rn > k * 126 AND rn <= k * 126 + 315)",
    f"st0 AS MATERIALIZED (SELECT split_num AS m, label AS y, 1.0::DOUBLE AS w, {LIST} FROM sp WHERE place <= 252)", *fit_sql.logistic_ctes("ls", "st0", FEATURES),
    f"me AS MATERIALIZED (SELECT m, symbol, ts, rn, {fit_sql.probability('ls', FEATURES)} AS p FROM sp JOIN ls ON m = split_num WHERE place > 252)",
    *LEDGER_OF_SCORES,
]


@query("j08_train_and_score", recursive(*result_sql(SPLIT_FITS), "cn AS (SELECT m, symbol, count(*) AS scored FROM me GROUP BY m, symbol)")
       + f"SELECT cn.symbol, m AS split_num, scored, {shown()} FROM cn JOIN res ON res.symbol = cn.symbol || '#' || m")
def train_and_score(spark, sf_dir):
    """One model for each walk-forward split, all fitted together, then one ledger job over all splits."""
    df = model_frame(spark, sf_dir)
    rows = saved(wf.assign_rows(wf.number_rows(df), wf.series_lengths(df), 252, 63, 126), "split-rows")
    models = km.fit_logistic(rows.where("role = 'train'"), ["split_num"], FEATURES)
    scored = saved(km.score(rows.where("role = 'test'"), models, ["split_num"], FEATURES), "split-scores")
    series = keyed_series("symbol", "split_num")
    test = led.backtest(sig.long_only_model_rule(scored, 0.52), FREE, series)
    counts = scored.groupBy("symbol", "split_num").agg(F.count(F.lit(1)).alias("scored"))
    return rounded(counts.join(table_of(test, series, RESULT), ["symbol", "split_num"]), 4)


@query("a18_model_round_trip", stages(BARS, *FRAME) + "SELECT symbol, ts, 'logistic' AS kind, true AS same FROM mf WHERE role = 'test'")
def round_trip(spark, sf_dir):
    """A saved and loaded model gives the scores of the fitted one."""
    df = model_frame(spark, sf_dir)
    path = scratch_path(spark, "model")
    fresh = ml.fit(df.where("role = 'train'"), FEATURES, "logistic")
    sinks.save_model(fresh, path, FEATURES, {"kind": "logistic"})
    model, meta = sinks.load_model(spark, path)
    both = ml.score(model, ml.score(fresh, df.where("role = 'test'"), "before"), "after")
    return both.select("symbol", "ts", F.lit(meta["kind"]).alias("kind"), (F.col("before") == F.col("after")).alias("same"))


@query("h08_regressors", stages(BARS, *FRAME) + "SELECT m AS model, count(*) AS rows, true AS beats_mean FROM mf, (VALUES ('boosted'), ('forest'), ('linear')) v(m)"
       " WHERE role = 'train' GROUP BY m")
def regressors(spark, sf_dir):
    """Regression on the next return: on its own rows each fit leaves less than the variance."""
    df = model_frame(spark, sf_dir).where("role = 'train'")
    out = None
    for name, kind, params in (("linear", "linear_regression", {}), ("forest", "forest_regression", {}), ("boosted", "boosted_regression", {})):
        one = ml.predict_value(ml.fit(df, FEATURES, kind, "future_return", **params), df).agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("rows"),
            (F.avg(F.pow(F.col("predicted") - F.col("future_return"), 2)) < F.var_pop("future_return")).alias("beats_mean"),
        )
        out = one if out is None else out.unionByName(one)
    return out
