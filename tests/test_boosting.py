"""Second-order boosting of several keys in blocks against one plain numpy fit for each key."""

from __future__ import annotations

import numpy as np
import pandas as pd

from candela.operators import boosting as bo

FEATURES = ["a", "b", "c"]


def plain(x, y, marks, cuts, plan):
    """Trees grown one after another, node by node, on all rows of one key; returns the margins."""
    binned = np.column_stack([np.searchsorted(cuts[k], x[:, k]) for k in range(x.shape[1])])
    margin = np.zeros(len(y))
    for t in range(plan.rounds):
        columns, seen = plan.features(t, x.shape[1]), plan.drawn(t, marks)
        p = 1 / (1 + np.exp(-margin))
        g, h = (p - y) * seen, p * (1 - p) * seen

        def grow(rows, depth):
            best, split = 0.0, None
            if depth < plan.depth:
                for f in columns:
                    for cut in range(plan.bins):
                        left = rows & (binned[:, f] <= cut)
                        right = rows & ~left
                        if h[left].sum() < plan.least_curve or h[right].sum() < plan.least_curve:
                            continue
                        score = [g[r].sum() ** 2 / (h[r].sum() + plan.penalty) for r in (left, right, rows)]
                        gain = round(score[0] + score[1] - score[2], 9)
                        if gain > best:
                            best, split = gain, (left, right)
            if split is None:
                value = 0.0 if depth == 0 else -plan.rate * g[rows].sum() / (h[rows].sum() + plan.penalty)
                margin[rows] += value
                return
            grow(split[0], depth + 1)
            grow(split[1], depth + 1)

        grow(np.ones(len(y), bool), 0)
    return 1 / (1 + np.exp(-margin))


def test_equals_plain_boosting(spark, monkeypatch):
    monkeypatch.setattr(bo, "WRITTEN_AFTER", 3)
    monkeypatch.setattr(bo, "BLOCK_ROWS", 50)
    draw = np.random.default_rng(2)
    parts = []
    for key, n in (("one", 160), ("two", 240)):
        x = draw.normal(size=(n, 3)).round(2)
        y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) ^ (draw.random(n) < 0.1)).astype(int)
        parts.append(pd.DataFrame({"key": key, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))
    frame = pd.concat(parts, ignore_index=True)
    frame["id"] = range(len(frame))
    rows = spark.createDataFrame(frame).repartition(3)
    plan = bo.Boosting(rounds=5, depth=2, rate=0.3, bins=8)
    models, cuts = bo.fit_boosted(rows, ["key"], FEATURES, plan=plan)
    got = {r["id"]: r["prob_up"] for r in bo.score_boosted(rows, models, cuts, ["key"], FEATURES, plan=plan).collect()}
    marks = {r["id"]: r["m"] for r in rows.selectExpr("id", "xxhash64(id) AS m").collect()}
    assert len(got) == len(frame)
    for key, part in frame.groupby("key"):
        want = plain(part[FEATURES].to_numpy(), part["label"].to_numpy(), np.array([marks[i] for i in part["id"]]), cuts, plan)
        assert np.allclose([got[i] for i in part["id"]], want, atol=1e-9)
    right = np.mean([(got[i] > 0.5) == bool(y) for i, y in zip(frame["id"], frame["label"])])
    assert right > 0.7
    odd = spark.createDataFrame([("one", None, 1.0, 1.0), ("none", 1.0, 1.0, 1.0)], "key string, a double, b double, c double")
    assert [r["prob_up"] for r in bo.score_boosted(odd, models, cuts, ["key"], FEATURES, plan=plan).collect()] == [None, None]
