"""Model fitting with Spark ML, time-series validation, balancing and calibration."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.durable import materialize
from candela.functions.guards import c
from candela.functions.series import BLOCK, CHUNK, RN, Series, index
from candela.operators.evaluation import apply_scaler, binary_metrics, fit_scaler, weighted_metrics


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")


def estimator(kind: str, label: str = "label", weight: str | None = None, seed: int = 42, **params):
    """One of ``logistic``, ``lasso``, ``random_forest``, ``gradient_boosting`` and their regressors.

    Sizes and rates are fixed values that the reference models have; classes are balanced by ``weight``.
    """
    common = {"labelCol": label, **({"weightCol": weight} if weight else {})}
    if kind == "logistic":
        return LogisticRegression(**common, **{"maxIter": 1000, "tol": 1e-8, "regParam": 0.01, **params})
    if kind == "lasso":
        return LogisticRegression(**common, **{"maxIter": 1000, "regParam": 0.01, "elasticNetParam": 1.0, **params})
    forest = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 10, "seed": seed}
    boosting = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": seed}
    if kind == "random_forest":
        return RandomForestClassifier(**common, **{**forest, **params})
    if kind == "gradient_boosting":
        return GBTClassifier(**common, **{**boosting, **params})
    if kind == "linear_regression":
        return LinearRegression(**common, **{"maxIter": 1000, **params})
    if kind == "forest_regression":
        return RandomForestRegressor(**common, **{**forest, **params})
    if kind == "boosted_regression":
        return GBTRegressor(**common, **{**boosting, **params})
    raise ValueError(f"unknown model {kind}")


def fit(train: DataFrame, features: list[str], kind: str, label: str = "label", weight: str | None = None, **params) -> PipelineModel:
    """Fit assembler and model as one pipeline, so scoring can never skip the preparation."""
    return Pipeline(stages=[assembler(features), estimator(kind, label, weight, **params)]).fit(train)


def score(model: PipelineModel, df: DataFrame, out: str = "prob_up") -> DataFrame:
    """Add the probability of class 1."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def predict_value(model: PipelineModel, df: DataFrame, out: str = "predicted") -> DataFrame:
    """Add the value that a regressor predicts."""
    return model.transform(df).withColumnRenamed("prediction", out).drop("features")


def score_splits(rows: DataFrame, features: list[str], kind: str, split: str = "split_num", **params) -> DataFrame:
    """Scores of the test rows of every split by a model of its train rows.

    The fits of different splits are independent Spark jobs and are started from a small thread pool.
    """
    numbers = [row[0] for row in rows.select(split).distinct().orderBy(split).collect()]

    def one(k) -> DataFrame:
        part = rows.where(c(split) == k)
        return score(fit(part.where("role = 'train'"), features, kind, **params), part.where("role = 'test'"))

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, numbers))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def soft_vote(df: DataFrame, probabilities: list[str], out: str = "prob_vote") -> DataFrame:
    return df.withColumn(out, sum((c(p) for p in probabilities), F.lit(0.0)) / len(probabilities))


def hard_vote(df: DataFrame, probabilities: list[str], need: int, out: str = "vote") -> DataFrame:
    votes = sum(((c(p) > 0.5).cast("int") for p in probabilities), F.lit(0))
    return df.withColumn(out, (votes >= need).cast("int"))


def compare_models(df: DataFrame, label: str, models: dict[str, Column]) -> DataFrame:
    """Accuracy, precision, recall and F1 per model from one pass, best accuracy marked."""
    stacked = df.select(
        c(label).alias("label"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("prediction")) for n, p in models.items()])),
    )
    m = binary_metrics(stacked, ["model"])
    top = m.agg(F.max_by("model", "accuracy").alias("_best"))  # one row per model
    return m.crossJoin(F.broadcast(top)).withColumn("best", c("model") == c("_best")).drop("_best")


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """Feature importances of trees, or absolute coefficients of a linear model, as rows."""
    from pyspark.sql import SparkSession

    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(n, abs(float(v))) for n, v in zip(features, values.toArray())]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def cross_validate(folded: DataFrame, features: list[str], kind: str, folds: int = 5, label: str = "label", **params) -> DataFrame:
    """Fit on the past and score the next part for each expanding fold; mean and deviation of the scores.

    The fits are independent Spark jobs and are started from a small thread pool.
    """
    def one(k: int) -> DataFrame:
        part = folded.where(c("fold") == k)
        model = fit(part.where("role = 'train'"), features, kind, label, **params)
        scored = score(model, part.where("role = 'test'"))
        scored = scored.withColumn("prediction", (c("prob_up") > 0.5).cast("int"))
        return weighted_metrics(scored.withColumn("fold", F.lit(k)), ["fold"], label)

    with ThreadPoolExecutor(3) as pool:
        parts = list(pool.map(one, range(1, folds + 1)))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    return scores


def summarize_folds(scores: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return scores.groupBy(*keys).agg(
        *[f(n).alias(f"{n}_{t}") for n in ("accuracy", "f1_score") for t, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )


def grid_search(folded: DataFrame, features: list[str], kind: str, grid: dict[str, list], folds: int = 3, label: str = "label") -> DataFrame:
    """Mean fold score of every grid point, best first."""
    out = None
    names = list(grid)
    for values in product(*grid.values()):
        params = dict(zip(names, values))
        row = summarize_folds(cross_validate(folded, features, kind, folds, label, **params))
        row = row.select(*[F.lit(v).alias(n) for n, v in params.items()], "accuracy_mean", "f1_score_mean")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("f1_score_mean"), *names)


def sampled_search(
    folded: DataFrame, features: list[str], kind: str, grid: dict[str, list], points: int = 20, folds: int = 5, label: str = "label", seed: int = 42
) -> DataFrame:
    """Mean fold score of ``points`` points drawn from the grid without repeats, best first.

    Each fold is assembled and kept once; the fits are started from a small thread pool.
    """
    drawn = random.Random(seed).sample(list(product(*grid.values())), points)
    names = list(grid)
    parts = {(k, r): folded.where((c("fold") == k) & (c("role") == r)).persist() for k in range(1, folds + 1) for r in ("train", "test")}

    def one(job) -> DataFrame:
        number, k = job
        model = fit(parts[k, "train"], features, kind, label, **dict(zip(names, drawn[number])))
        scored = score(model, parts[k, "test"]).withColumn("prediction", (c("prob_up") > 0.5).cast("int"))
        return weighted_metrics(scored.withColumns({"fold": F.lit(k), "_point": F.lit(number)}), ["_point", "fold"], label)

    try:
        with ThreadPoolExecutor(8) as pool:
            jobs = list(pool.map(one, product(range(points), range(1, folds + 1))))
            rows = [r for found in pool.map(lambda df: df.collect(), jobs) for r in found]  # one row for each fit
    finally:
        for p in parts.values():
            p.unpersist()
    spark = folded.sparkSession
    scores = summarize_folds(spark.createDataFrame(rows), ["_point"])
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(drawn)], ["_point", *names])
    return table.join(scores, "_point").select(*names, "accuracy_mean", "f1_score_mean").orderBy(F.desc("f1_score_mean"), *names)


def calibrate(scored: DataFrame, label: str = "label", raw: str = "prob_up", out: str = "prob_calibrated") -> DataFrame:
    """Platt scaling: a one-feature logistic model on held-out scores."""
    model = fit(scored, [raw], "logistic", label, regParam=0.0)
    return score(model, scored, out)


def out_of_fold(df: DataFrame, features: list[str], kind: str, folds: int = 5, label: str = "label", key: str = "id") -> DataFrame:
    """Scores from models that did not see the row; folds by a hash of the row key."""
    folded = df.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    out = None
    for k in range(folds):
        model = fit(folded.where(c("_fold") != k), features, kind, label)
        part = score(model, folded.where(c("_fold") == k))
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


# ---- minority oversampling -----------------------------------------------------------------


def nearest_neighbours(points: DataFrame, features: list[str], k: int = 5, key: str = "id", pivots: int = 64) -> DataFrame:
    """Exact k nearest neighbours of every row among all other rows: columns ``key, rank, neighbour``.

    Rows belong to the cell of their nearest pivot.  A first join inside cells
    bounds the distance of the k-th neighbour; by the triangle inequality a
    second join only visits cells that may hold something nearer.  Blocks of
    about 2,000 rows meet in numpy: one matrix product finds the pairs that are
    not beyond the bound, with room for its rounding, and only these are
    measured and ranked, by distance and then key.  A block travels once for
    each cell it visits.  Work inside a cell grows with the square of its
    blocks, so ``pivots`` should grow with the square root of the rows.
    """
    import numpy as np
    import pandas as pd

    # a bounded number of pivots is held by the driver; any choice gives the same answer
    rows = points.select(*features).orderBy(F.xxhash64(key)).limit(pivots).collect()
    centers = np.array([[float(v) for v in r] for r in rows])
    pts = points.select(key, F.array(*[c(n).cast("double") for n in features]).alias("x"))
    block_rows, step, room = 2000, 128, 1e-12

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                d = np.stack([np.sqrt(((x - center) ** 2).sum(1)) for center in centers], axis=1)
                yield pdf.assign(cell=d.argmin(1).astype("int32"), dist=d.min(1))

    kind = dict(points.dtypes)[key]
    celled = materialize(pts.mapInPandas(assign, f"{key} {kind}, x array<double>, cell int, dist double"))
    sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    split = celled.join(F.broadcast(sizes), "cell").withColumn(
        "part", F.pmod(F.xxhash64(key), F.ceil(c("_n") / block_rows)).cast("int")
    ).drop("_n")

    def blocked(df):
        """One row for each block: its keys, its values row by row, and the bounds of its rows."""
        made = df.groupBy("cell", "part").agg(F.collect_list(F.struct(F.col(key).alias("id"), "x", "bound")).alias("rows"))
        return materialize(made.select(
            "cell", "part", F.transform("rows", lambda r: r["id"]).alias("ids"),
            F.flatten(F.transform("rows", lambda r: r["x"])).alias("values"), F.transform("rows", lambda r: r["bound"]).alias("bounds"),
        ))

    def meet(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids_a, ids_b, bounds = (np.asarray(v) for v in (row.left_ids, row.right_ids, row.left_bounds))
                a, b = (np.asarray(v).reshape(len(ids), -1) for v, ids in ((row.left_values, ids_a), (row.right_values, ids_b)))
                aa, bb = (a**2).sum(1), (b**2).sum(1)
                found = []
                for at in range(0, len(a), step):
                    part = slice(at, at + step)
                    square = a[part] @ b.T
                    square *= -2
                    square += bb
                    square += aa[part, None]
                    limit = bounds[part] ** 2
                    # a row that has no bound yet keeps its k nearest here; it may meet itself
                    if np.isinf(limit).any() and len(b) > k + 1:
                        limit = np.minimum(limit, np.maximum(np.partition(square, k, axis=1)[:, k], 0))
                    limit = limit + room * (aa[part] + bb.max() + np.where(np.isinf(limit), 0, limit))
                    i, j = np.nonzero(square <= limit[:, None])
                    i = i + at
                    other = ids_a[i] != ids_b[j]
                    i, j = i[other], j[other]
                    d = np.sqrt(((a[i] - b[j]) ** 2).sum(1))
                    found.append(pd.DataFrame({key: ids_a[i], "neighbour": ids_b[j], "d": d}))
                out = pd.concat(found).sort_values([key, "d", "neighbour"])
                yield out.groupby(key, sort=False).head(k)

    side = lambda df, name: df.select(
        F.col("cell").alias(f"{name}_cell"), F.col("ids").alias(f"{name}_ids"), F.col("values").alias(f"{name}_values"), F.col("bounds").alias(f"{name}_bounds"))
    schema = f"{key} {kind}, neighbour {kind}, d double"
    met_columns = ["left_ids", "left_values", "left_bounds", "right_ids", "right_values"]
    blocks = blocked(split.withColumn("bound", F.lit(float("inf"))))
    inside = side(blocks, "left").join(side(blocks, "right"), c("left_cell") == c("right_cell")).select(*met_columns)
    near = materialize(inside.mapInPandas(meet, schema))
    best = lambda df: df.groupBy(key).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("d", "neighbour"))), 1, k).alias("best")
    )
    first = best(near)
    reach = materialize(split.join(first, key, "left").withColumn(
        "bound", F.when(F.size("best") >= k, F.element_at("best", k)["d"]).otherwise(F.lit(float("inf")))
    ).drop("best"))
    gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(-1))
    # a row must visit another cell when its bound reaches past the half-way plane or the cell's ring
    cells = celled.groupBy("cell").agg(F.max("dist").alias("radius"))
    pairs = points.sparkSession.createDataFrame(
        [(int(i), int(j), float(gap[i, j])) for i in range(len(centers)) for j in range(len(centers)) if i != j],
        "cell int, other int, gap double",
    )
    visits = reach.join(F.broadcast(pairs.join(cells.withColumnRenamed("cell", "other"), "other")), "cell").where(
        c("gap") - c("dist") - c("radius") <= c("bound") + room * (c("gap") + c("dist") + c("radius"))
    )
    visits = visits.groupBy("cell", "part", "other").agg(F.lit(1).alias("_one")).drop("_one")  # at most one row for each block and cell
    asks = blocked(reach).join(visits, ["cell", "part"]).select("other", *[F.col(n).alias(f"left_{n}") for n in ("ids", "values", "bounds")])
    across = asks.join(side(blocks, "right"), c("other") == c("right_cell")).select(*met_columns)
    every = near.unionByName(across.mapInPandas(meet, schema))
    return best(every).select(key, F.posexplode("best").alias("pos", "_b")).select(
        key, (c("pos") + 1).alias("rank"), c("_b.neighbour").alias("neighbour"), c("_b.d").alias("distance")
    )


def smote(df: DataFrame, features: list[str], label: str = "label", minority: int = 1, k: int = 5, seed: int = 42, key: str = "id") -> DataFrame:
    """Add synthetic minority rows between a row and one of its k neighbours until the classes match.

    Which neighbour and how far along is a hash of seed, row and copy, so the
    result does not change when a task runs again.
    """
    few = df.where(c(label) == minority)
    sizes = df.agg(F.count_if(c(label) == minority).alias("_few"), F.count_if(c(label) != minority).alias("_many"))
    near = nearest_neighbours(few, features, k, key)
    # copies per row: the deficit spread evenly, the remainder by rank of the row's hash
    deficit = F.greatest(c("_many") - c("_few"), F.lit(0))
    # rows in the order of their hashes, numbered without one task for all; the first ones make the remainder
    by_hash = few.withColumns({"_all": F.lit(0), "_h": F.xxhash64(F.lit(seed), F.lit("keep"), key)})
    order = Series(("_all",), ("_h", key), lambda: [F.shiftright("_h", 48)])
    draw = index(by_hash, order).drop("_all", "_h", CHUNK, BLOCK).crossJoin(F.broadcast(sizes))
    remainder = F.expr("greatest(_many - _few, 0L) % _few")
    copies = (F.floor(deficit / c("_few")) + F.when(c(RN) <= remainder, 1).otherwise(0)).cast("int")
    draw = draw.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), c("_copies")))).drop(RN)
    u = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key, "_copy"), F.lit(1000000)) / 1000000.0
    counts = near.groupBy(key).agg(F.max("rank").alias("_have"))
    draw = draw.join(counts, key).withColumn("rank", (F.floor(u("which") * c("_have")) + 1).cast("int"))
    other = few.select(F.col(key).alias("neighbour"), *[F.col(n).alias(f"_o_{n}") for n in features])
    made = draw.withColumn("_t", u("where")).join(near.select(key, "rank", "neighbour"), [key, "rank"]).join(other, "neighbour")
    synthetic = made.select(
        F.lit(None).cast(dict(df.dtypes)[key]).alias(key), c(label),
        *[(c(n) + c("_t") * (c(f"_o_{n}") - c(n))).alias(n) for n in features], F.lit(True).alias("synthetic"),
    )
    return df.select(key, label, *features, F.lit(False).alias("synthetic")).unionByName(synthetic)


def scaled(df: DataFrame, features: list[str]) -> DataFrame:
    return apply_scaler(df, fit_scaler(df, features), features)
