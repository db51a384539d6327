"""Walk-forward scores of fitted models on hourly bars, which the rules, votes, sweeps and reports of scores read.

One logistic model for each of four horizons and one with balanced classes are fitted on the past of each of five
expanding folds, all at once; each test part is scored by the models of its fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.durable import materialize, saved
from candela.functions.keytables import per_key
from candela.operators import indicators as ind
from candela.operators import keyed_models as km
from candela.operators import regimes as reg
from candela.operators import walkforward as wf
from candela.plans import fit_sql
from candela.plans.indicator_queries import WIDE, WIDE_COLS
from candela.plans.sqltext import OVER, lead
from candela.sources.driver_tables import event_bars

#: Twenty clean features; all of them are known from the 28th bar of a series on.
FEATURES = [
    "returns", "returns_lag_1", "returns_lag_2", "returns_lag_3", "returns_lag_5", "momentum_5", "momentum_10", "momentum_20", "hl_ratio",
    "co_ratio", "gap", "rsi_14", "macd_hist", "bb_width_20", "bb_position_20", "atr_percent_14", "stoch_k_14", "adx_14", "cci_20", "volatility_20",
]
FOLDS = 5
#: Score column: (bars ahead, balanced classes).
MODELS = {"prob_up": (1, False), "prob_alt": (3, False), "prob_3": (5, False), "prob_4": (10, False), "prob_balanced": (1, True)}
HORIZON_SCORES = ["prob_up", "prob_alt", "prob_3", "prob_4"]
HORIZONS = sorted({h for h, _ in MODELS.values()})


def feature_rows(spark, sf_dir, series=None) -> DataFrame:
    """Bars with the features, all that the rules read, row numbers ``rn`` and, for each horizon, whether the close is higher then."""
    bars = event_bars(spark, sf_dir)
    parts = ind.chain(ind.returns(), ind.beside(
        ind.lagged_returns(), ind.momentum(), ind.bar_ratios(), ind.gap(), ind.rsi(14), ind.macd(), ind.bollinger(20), ind.atr(14),
        ind.stochastic(), ind.adx_simple(14), ind.cci(20), ind.volatility((20,)), ind.momentum_features((10, 20)), ind.close_std(14),
        ind.sma((50, 200))))
    return wf.number_rows(reg.add_horizon_targets(parts(bars), HORIZONS))


def folded_rows(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Rows with all features, numbered ``i`` in their series, once for each fold, with the last row ``past`` before its test part."""
    valid = saved(wf.number_rows(df.dropna(subset=FEATURES), out="i"), "valid-rows")
    rows = valid.join(per_key(wf.series_lengths(valid)), "symbol").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    size = F.expr(f"n div {folds + 1}")
    return rows.withColumns({"past": F.col("n") - (folds + 1 - F.col("fold")) * size, "size": size})


def training_rows(rows: DataFrame) -> DataFrame:
    """fold, model, label, features: the past of each fold whose label is known before its test part begins."""
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("ahead"), F.col(f"target_{h}").alias("label")) for m, (h, _) in MODELS.items()]))
    known = rows.where("i < past").select("fold", "i", "past", *FEATURES, each).where("label IS NOT NULL AND i + ahead <= past")
    balanced = [m for m, (_, b) in MODELS.items() if b]
    weighted = km.balanced_weights(known, ["fold", "model"])
    return weighted.withColumn("weight", F.when(F.col("model").isin(balanced), F.col("weight")).otherwise(1.0))


def fitted_models(rows: DataFrame) -> DataFrame:
    return km.fit_logistic(training_rows(rows), ["fold", "model"], FEATURES, weight="weight")


def scored_bars(spark, sf_dir) -> DataFrame:
    """The score store: all bars of test parts, with one column for each model."""
    rows = folded_rows(feature_rows(spark, sf_dir))
    models = fitted_models(rows)
    one = {m: F.max(F.when(F.col("model") == m, F.struct("intercept", "coefficients"))).alias(f"_{m}") for m in MODELS}
    table = models.groupBy("fold").agg(*one.values())
    test = rows.where("i > past AND i <= past + size").join(F.broadcast(table), "fold")  # one row a fold
    probs = {m: km.probability(F.col(f"_{m}.intercept"), F.col(f"_{m}.coefficients"), FEATURES) for m in MODELS}
    return materialize(test.withColumns(probs).drop(*[f"_{m}" for m in MODELS], "past", "size", "n", "i"))


def feature_sql() -> list[str]:
    """``ft``: bars with the features and the labels of all horizons; ``fv``: rows with all features, numbered."""
    cols = {f: WIDE_COLS[f].partition(":")[2] for f in FEATURES}
    ys = ", ".join(f"CASE WHEN {lead('close', h)} IS NOT NULL THEN CAST({lead('close', h)} > close AS INTEGER) END AS y{h}" for h in HORIZONS)
    return [
        *WIDE,
        f"ft AS (SELECT symbol, ts, {', '.join(f'{e} AS {f}' for f, e in cols.items())}, {ys} FROM f4)",
        f"fv AS MATERIALIZED (SELECT *, row_number() OVER ({OVER}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ft WHERE "
        + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES) + ")",
    ]


def score_sql() -> list[str]:
    """``scores`` (symbol, ts, fold, one column for each model)."""
    past, size = f"n - ({FOLDS + 1} - fold) * (n // {FOLDS + 1})", f"(n // {FOLDS + 1})"
    stack = " UNION ALL ".join(
        f"SELECT fold || '{m}' AS m, y{h} AS y, "
        + (f"count(*) OVER (PARTITION BY fold) / (2.0 * count(*) OVER (PARTITION BY fold, y{h}))" if b else "1.0") + f"::DOUBLE AS w, {', '.join(FEATURES)}"
        f" FROM fk WHERE i + {h} <= past AND y{h} IS NOT NULL" for m, (h, b) in MODELS.items())
    joins = " ".join(f"JOIN lg AS l_{m} ON l_{m}.m = fold || '{m}'" for m in MODELS)
    return [
        *feature_sql(),
        f"fk AS MATERIALIZED (SELECT fv.*, fold, {past} AS past, {size} AS size FROM fv, range(1, {FOLDS + 1}) t(fold))",
        f"fr AS MATERIALIZED ({stack})",
        *fit_sql.logistic_ctes("lg", "fr", FEATURES),
        f"scores AS MATERIALIZED (SELECT symbol, ts, fold, {', '.join(f'{fit_sql.probability(f'l_{m}', FEATURES)} AS {m}' for m in MODELS)}"
        f" FROM fk {joins} WHERE i > past AND i <= past + size)",
    ]
