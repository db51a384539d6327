"""Logistic models of many keys fitted together: splits, folds, horizons, thresholds and kinds are columns.

A Newton step of all models is one pass over the rows.  Rows are packed into blocks of their key; each block gives the
loss, the slope and the curvature at its model's place; these add up by key, in any order and with partial sums before
the shuffle, and each model is solved by itself.  So neither a fit nor a plan is repeated for a key, a key with most of
the rows is spread over as many tasks as it has blocks, and a model that has converged drops out of the next pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.durable import saved
from candela.functions.guards import c
from candela.functions.keytables import FEW_ROWS

#: Rows that a block has at most.
BLOCK_ROWS = 4096
#: A model has converged when no standardised coefficient moves further in a step.
TOLERANCE, MOST_STEPS = 1e-8, 100


def pack(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
    """keys, rows, x, y, w: float64 matrices of the rows of a key that a task meets; rows with a null are left out."""
    d = len(features)
    used = rows.select(*keys, *[c(n).cast("double").alias(f"_x{k}") for k, n in enumerate(features)], c(label).cast("double").alias("_y"),
                       (c(weight) if weight else F.lit(1.0)).cast("double").alias("_w")).dropna()
    kinds = dict(used.dtypes)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, part in batch.groupby(list(keys), sort=False):
                m = part[[*[f"_x{k}" for k in range(d)], "_y", "_w"]].to_numpy(np.float64)
                for at in range(0, len(m), BLOCK_ROWS):
                    cut = m[at : at + BLOCK_ROWS]
                    out.append((*key, len(cut), np.ascontiguousarray(cut[:, :d]).tobytes(), cut[:, d].tobytes(), cut[:, d + 1].tobytes()))
            yield pd.DataFrame(out, columns=[*keys, "rows", "x", "y", "w"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", rows bigint, x binary, y binary, w binary"
    return saved(used.mapInPandas(blocks, schema), "model-blocks")


def matrices(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, w = np.frombuffer(row["y"]), np.frombuffer(row["w"])
    return np.frombuffer(row["x"]).reshape(len(y), -1), y, w


def keyed_sums(blocks: DataFrame, keys: Sequence[str], vector: Callable[[dict], np.ndarray]) -> DataFrame:
    """keys and ``sums``: the vectors of all blocks of a key added up, with partial sums before the shuffle."""
    kinds = dict(blocks.dtypes)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch[list(keys)].copy()
            made["v"] = [vector(r) for r in batch.to_dict("records")]
            yield made

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", v array<double>"
    each = blocks.mapInPandas(vectors, schema).select(*keys, F.posexplode("v").alias("pos", "value"))
    parts = each.groupBy(*keys, "pos").agg(F.sum("value").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return parts.groupBy(*keys).agg(F.transform(ordered, lambda p: p["value"]).alias("sums"))


def _beside(blocks: DataFrame, table: DataFrame, keys: Sequence[str], few: bool) -> DataFrame:
    """Each block with its key's row; broadcast while the counted keys are few, so that few keys are not few tasks."""
    return blocks.join(F.broadcast(table) if few else table, list(keys))


def _logistic_sums(r: dict) -> np.ndarray:
    """Loss, slope and upper triangle of the curvature of one block at ``theta``, intercept first."""
    x, y, w = matrices(r)
    scale = np.asarray(r["scale"])
    z = np.column_stack([np.ones(len(y)), (x - np.asarray(r["mean"])) * scale])
    margin = z @ np.asarray(r["theta"])
    p = 1 / (1 + np.exp(-margin))
    loss = (w * (np.logaddexp(0, margin) - y * margin)).sum()
    slope = z.T @ (w * (p - y))
    curve = (z * (w * p * (1 - p))[:, None]).T @ z
    return np.concatenate([[loss], slope, curve[np.triu_indices(len(slope))]])


def _softmax_sums(r: dict) -> np.ndarray:
    """The same of a model of several classes; ``theta`` has one row for each class."""
    x, y, w = matrices(r)
    z = np.column_stack([np.ones(len(y)), (x - np.asarray(r["mean"])) * np.asarray(r["scale"])])
    theta = np.asarray(r["theta"]).reshape(-1, z.shape[1])
    margin = z @ theta.T
    margin -= margin.max(axis=1, keepdims=True)
    p = np.exp(margin)
    p /= p.sum(axis=1, keepdims=True)
    hit = np.eye(len(theta))[y.astype(int)]
    loss = -(w * np.log(np.maximum((p * hit).sum(axis=1), 1e-300))).sum()
    slope = ((p - hit) * w[:, None]).T @ z
    wide = slope.size
    curve = np.empty((len(theta), z.shape[1], len(theta), z.shape[1]))
    for a in range(len(theta)):
        for b in range(len(theta)):
            curve[a, :, b, :] = (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
    return np.concatenate([[loss], slope.ravel(), curve.reshape(wide, wide)[np.triu_indices(wide)]])


def _stepped(r: dict, reg: float, classes: int) -> dict:
    """A model after one Newton step, or halfway back where the last one made the loss greater."""
    sums, theta, before = (np.asarray(r[k], float) for k in ("sums", "theta", "before"))
    wide = len(theta)
    penalty = np.full(wide, reg)
    penalty[:: wide // max(1, classes if classes > 2 else 1)] = 0  # intercepts are free
    total = r["weight"]
    loss = sums[0] / total + 0.5 * (penalty * theta**2).sum()
    if loss > r["loss"] * (1 + 1e-12) + 1e-15 and np.abs(theta - before).max() > TOLERANCE:
        return {"theta": (theta + before) / 2, "before": before, "loss": r["loss"], "done": False}
    slope = sums[1 : 1 + wide] / total + penalty * theta
    curve = np.zeros((wide, wide))
    curve[np.triu_indices(wide)] = sums[1 + wide :] / total
    curve = curve + np.triu(curve, 1).T + np.diag(penalty)
    step = np.linalg.lstsq(curve, slope, rcond=1e-12)[0]
    return {"theta": theta - step, "before": theta, "loss": loss, "done": bool(np.abs(step).max() < TOLERANCE)}


def fit_logistic(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", weight: str | None = None, reg: float = 0.01, classes: int = 2,
) -> DataFrame:
    """One row for each key: keys, rows, steps, intercept and coefficients, for ``classes`` of three or more as arrays by class.

    The mean weighted loss plus half of ``reg`` times the squared coefficients of the standardised features is least
    there; labels are 0, 1 and so on.  Rows with a null are left out.  A model of two classes that has seen one only
    gives that class for certain.  ``keys`` must not be empty; add a constant for a single model.
    """
    keys, d = list(keys), len(features)
    blocks = pack(rows, keys, features, label, weight)

    def first(r: dict) -> np.ndarray:
        x, y, w = matrices(r)
        by_class = np.bincount(y.astype(int), weights=w, minlength=classes)
        return np.concatenate([[len(y), w.sum(), (w * w).sum()], by_class, w @ x])

    counts = saved(keyed_sums(blocks, keys, first), "model-counts")
    few = counts.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    mean = F.transform(F.slice("sums", 4 + classes, d), lambda v: v / F.get("sums", F.lit(1)))
    counts = counts.select(*keys, "sums", mean.alias("mean"))

    def second(r: dict) -> np.ndarray:
        x, _, w = matrices(r)
        return w @ (x - np.asarray(r["mean"])) ** 2

    spread = keyed_sums(_beside(blocks, counts.select(*keys, "mean"), keys, few), keys, second).withColumnRenamed("sums", "squares")
    free = F.get("sums", F.lit(1)) - F.get("sums", F.lit(2)) / F.get("sums", F.lit(1))  # n - 1 without weights
    scale = F.transform("squares", lambda s: F.when((s > 0) & (free > 0), F.sqrt(free / s)).otherwise(0.0))
    start = counts.join(spread, keys).select(*keys, "sums", "mean", scale.alias("scale"))
    kinds = dict(start.dtypes)
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            sums = [np.asarray(s) for s in b["sums"]]
            by_class = [s[3 : 3 + classes] for s in sums]
            certain = [classes == 2 and (n == 0).any() for n in by_class]
            thetas = []
            for n, one in zip(by_class, certain):
                if classes == 2:
                    t = np.zeros(d + 1)
                    t[0] = (np.inf if n[1] else -np.inf) if one else np.log(n[1] / n[0])
                else:
                    t = np.zeros((classes, d + 1))
                    shares = np.log(np.maximum(n, 0.5))
                    t[:, 0] = shares - shares.mean()
                thetas.append(t.ravel())
            out["rows"], out["weight"] = [int(s[0]) for s in sums], [s[1] for s in sums]
            out["mean"], out["scale"], out["theta"], out["before"] = b["mean"], b["scale"], thetas, thetas
            out["loss"], out["steps"], out["done"] = np.inf, 0, certain
            yield out

    state_schema = key_schema + ", rows bigint, weight double, mean array<double>, scale array<double>, theta array<double>, before array<double>, loss double, steps int, done boolean"
    state = saved(start.mapInPandas(begin, state_schema), "model-state")
    vector = _logistic_sums if classes == 2 else _softmax_sums

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            new = pd.DataFrame([_stepped(r, reg, classes) for r in b.to_dict("records")], columns=["theta", "before", "loss", "done"])
            out = b.drop(columns=["sums"])
            out[["theta", "before", "loss", "done"]] = new.to_numpy()
            out["loss"], out["done"] = out["loss"].astype(float), out["done"].astype(bool)
            yield out.assign(steps=out["steps"] + 1)

    for _ in range(MOST_STEPS):
        going = state.where("NOT done")
        if going.limit(1).count() == 0:
            break
        sums = keyed_sums(_beside(blocks, going.select(*keys, "mean", "scale", "theta"), keys, few), keys, vector)
        moved = going.join(sums, keys).select(*state.columns, "sums").mapInPandas(solve, state_schema)
        state = saved(state.where("done").unionByName(moved), "model-state")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[*keys, "rows", "steps"]].copy()
            tables = [np.asarray(t).reshape(-1, d + 1) for t in b["theta"]]
            slopes = [t[:, 1:] * np.asarray(s) for t, s in zip(tables, b["scale"])]
            bases = [t[:, 0] - a @ np.asarray(m) for t, a, m in zip(tables, slopes, b["mean"])]
            out["intercept"] = [v[0] if classes == 2 else v for v in bases]
            out["coefficients"] = [a[0] if classes == 2 else list(a) for a in slopes]
            yield out

    wide = "intercept double, coefficients array<double>" if classes == 2 else "intercept array<double>, coefficients array<array<double>>"
    return saved(state.mapInPandas(finish, f"{key_schema}, rows bigint, steps int, {wide}"), "models")


def _dot(intercept: Column, coefficients: Column, features: Sequence[str]) -> Column:
    return sum((F.get(coefficients, F.lit(k)) * c(n) for k, n in enumerate(features)), intercept)


def probability(intercept: Column, coefficients: Column, features: Sequence[str]) -> Column:
    """Probability of class 1 under a model of two classes; null where a feature is."""
    return 1 / (1 + F.exp(-_dot(intercept, coefficients, features)))


def with_models(rows: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with intercept and coefficients of their key's model, null where there is none."""
    table = models.select(*keys, "intercept", "coefficients")
    return rows.join(F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table, list(keys), "left")


def score(rows: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], out: str = "prob_up") -> DataFrame:
    """Add the probability of class 1 by the model of the row's key."""
    scored = with_models(rows, models, keys)
    return scored.withColumn(out, probability(c("intercept"), c("coefficients"), features)).drop("intercept", "coefficients")


def score_classes(rows: DataFrame, models: DataFrame, keys: Sequence[str], features: Sequence[str], classes: int, out: str = "prob") -> DataFrame:
    """Add ``out``_0, ``out``_1 ... , the probabilities of all classes, and ``predicted``, the most likely (the first, of equals)."""
    scored = with_models(rows, models, keys)
    margins = [_dot(F.get("intercept", F.lit(k)), F.get("coefficients", F.lit(k)), features) for k in range(classes)]
    top = F.greatest(*margins)
    scored = scored.withColumn("_e", F.array(*[F.exp(m - top) for m in margins]))
    whole = F.aggregate("_e", F.lit(0.0), lambda s, v: s + v)
    scored = scored.withColumns({f"{out}_{k}": F.get("_e", F.lit(k)) / whole for k in range(classes)})
    best = F.greatest(*[c(f"{out}_{k}") for k in range(classes)])
    predicted = F.lit(None).cast("int")
    for k in reversed(range(classes)):
        predicted = F.when(c(f"{out}_{k}") == best, k).otherwise(predicted)
    return scored.withColumn("predicted", predicted).drop("_e", "intercept", "coefficients")


def balanced_weights(rows: DataFrame, keys: Sequence[str], label: str = "label", out: str = "weight") -> DataFrame:
    """Add the weight that makes all classes of a key weigh the same: rows / (classes x rows of the class)."""
    sizes = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_classes"))
    table = saved(sizes.join(totals, list(keys)).select(*keys, label, (c("_all") / (c("_classes") * c("_n"))).alias(out)), "class-weights")
    return rows.join(F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table, [*keys, label])
