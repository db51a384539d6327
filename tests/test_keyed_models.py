"""Models of many keys fitted together, against one fit of Spark's for each key and against plain optimisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candela.operators import keyed_models as km
from candela.operators import ml

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(4)
    parts = []
    for key, n in enumerate((60, 400, 900)):
        x = draw.normal(size=(n, 3)) * [1, 10, 0.01] + [0, 5, 3]
        p = 1 / (1 + np.exp(-(x[:, 0] - 0.1 * x[:, 1] * (key - 1) + 0.5)))
        y = (draw.random(n) < p).astype(int)
        three = np.minimum(2, y + (draw.random(n) < 0.3))
        parts.append(pd.DataFrame({"split": key, "side": "x", "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "flat": 7.0, "label": y, "three": three, "w": 0.5 + draw.random(n)}))
    one = parts[0].assign(split=9, label=1)
    frame = pd.concat([*parts, one], ignore_index=True)
    frame.loc[3, "a"] = np.nan
    frame["id"] = range(len(frame))
    return spark.createDataFrame(frame).replace(float("nan"), None, subset=["a"]).repartition(4).cache()


def test_equals_a_fit_for_each_key(rows):
    for weight in (None, "w"):
        models = km.fit_logistic(rows, ["split", "side"], FEATURES, weight=weight)
        got = {(r["id"]): r["prob_up"] for r in km.score(rows, models, ["split", "side"], FEATURES).collect()}
        assert models.count() == 4 and models.agg(F.max("steps")).first()[0] < 15
        for key in (0, 1, 2):
            part = rows.where(F.col("split") == key)
            one = ml.score(ml.fit(part, FEATURES, "logistic", weight=weight, tol=1e-12), part, "single")
            for r in one.collect():
                assert abs(got[r["id"]] - r["single"]) < 1e-6
    certain = km.score(rows.where("split = 9"), models, ["split", "side"], FEATURES).where("a IS NOT NULL").select("prob_up").distinct().collect()
    assert [r[0] for r in certain] == [1.0]
    assert got[3] is None


def test_blocks_do_not_matter(rows, monkeypatch):
    whole = km.fit_logistic(rows, ["split"], FEATURES).orderBy("split").collect()
    monkeypatch.setattr(km, "BLOCK_ROWS", 7)
    parts = km.fit_logistic(rows.repartition(9), ["split"], FEATURES).orderBy("split").collect()
    for one, other in zip(whole, parts):
        assert one["rows"] == other["rows"]
        assert np.allclose(one["coefficients"], other["coefficients"], atol=1e-10)


def test_three_classes(rows):
    part = rows.where("split < 3")
    models = km.fit_logistic(part, ["split"], FEATURES, "three", classes=3)
    scored = km.score_classes(part, models, ["split"], FEATURES, 3).where("a IS NOT NULL").toPandas()
    names = ["prob_0", "prob_1", "prob_2"]
    assert np.allclose(scored[names].sum(axis=1), 1)
    assert (scored["predicted"] == scored[names].to_numpy().argmax(axis=1)).all()
    from pyspark.ml.functions import vector_to_array

    one = part.where("split = 2")
    model = ml.fit(one, FEATURES, "logistic", "three", tol=1e-12)
    single = model.transform(one).select("id", vector_to_array("probability").alias("p")).toPandas().merge(scored, on="id")
    assert np.allclose(np.stack(single["p"]), single[names], atol=1e-6)


def test_balanced_weights(rows):
    weighted = km.balanced_weights(rows.where("split < 3"), ["split"])
    sums = weighted.groupBy("split", "label").agg(F.sum("weight").alias("s")).groupBy("split").agg(F.min("s").alias("low"), F.max("s").alias("high")).collect()
    assert all(abs(r["low"] - r["high"]) < 1e-9 for r in sums)
