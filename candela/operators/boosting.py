"""Second-order boosting of many keys together, by histograms.

Features are cut at quantiles.  For each level of a tree, every block of rows adds up slopes and curvatures of the loss by
(node, feature, cut); these sums are added by key, and each key chooses the split of every node with the greatest gain under
a penalty on leaf values.  So a level of all models is one pass, and only sums are shuffled.  Rows and columns are drawn
by hashes, so a task that runs again draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.durable import saved
from candela.functions.guards import c
from candela.functions.keytables import FEW_ROWS
from candela.operators.keyed_models import BLOCK_ROWS, keyed_sums

#: Trees after which the margins of the rows are written down, so that a pass never walks more.
WRITTEN_AFTER = 10


@dataclass(frozen=True)
class Boosting:
    """Sizes and rates; the defaults are fixed values that the reference models have."""

    rounds: int = 200
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    penalty: float = 1.0
    least_curve: float = 1.0
    bins: int = 32
    seed: int = 42

    @property
    def nodes(self) -> int:
        return (1 << self.depth + 1) - 1

    def features(self, round_: int, d: int) -> np.ndarray:
        """The columns of a tree."""
        drawn = np.random.default_rng([self.seed, round_]).permutation(d)
        return np.sort(drawn[: max(1, round(self.columns * d))])

    def drawn(self, round_: int, marks: np.ndarray) -> np.ndarray:
        """Which rows a tree sees."""
        x = marks.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (self.seed + round_ + 1) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(self.rows * (1 << 53)))


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of one tree that each row stands in; ``feature`` is -1 where a node is not split."""
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)


def sums_of_level(x, y, w, margin, node, level: int, columns: np.ndarray, bins: int) -> np.ndarray:
    """Slopes and curvatures by (node of the level, feature, cut), as one vector."""
    p = 1 / (1 + np.exp(-margin))
    slope, curve = w * (p - y), w * p * (1 - p)
    place = node - ((1 << level) - 1)
    here = (place >= 0) & (place < 1 << level)
    out = np.zeros((2, 1 << level, x.shape[1], bins))
    for f in columns:
        cell = place[here] * bins + x[here, f]
        for k, v in enumerate((slope, curve)):
            out[k, :, f] = np.bincount(cell, weights=v[here], minlength=bins << level).reshape(-1, bins)
    return out.ravel()


def best_splits(sums: np.ndarray, level: int, d: int, columns: np.ndarray, plan: Boosting) -> list[tuple[int, int, int, float, float]]:
    """(node, feature, cut, value left, value right) of the nodes of a level for which a split gains."""
    g, h = sums.reshape(2, 1 << level, d, plan.bins)
    out = []
    for k in range(1 << level):
        if not h[k].any():
            continue
        gl, hl = np.cumsum(g[k], axis=1), np.cumsum(h[k], axis=1)
        gs, hs = gl[:, -1:], hl[:, -1:]
        gr, hr = gs - gl, hs - hl
        gain = gl**2 / (hl + plan.penalty) + gr**2 / (hr + plan.penalty) - gs**2 / (hs + plan.penalty)
        gain[(hl < plan.least_curve) | (hr < plan.least_curve)] = 0
        gain[np.setdiff1d(np.arange(d), columns)] = 0
        gain = np.round(gain, 9)  # equal gains stay equal in any order of adding
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 0:
            value = [-plan.rate * a[f, b] / (s[f, b] + plan.penalty) for a, s in ((gl, hl), (gr, hr))]
            out.append(((1 << level) - 1 + k, int(f), int(b), *value))
    return out


def quantile_cuts(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Edges of each feature's bins over all rows; a bounded number of values reaches the driver."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c(n).cast("double"), shares, 100_000).alias(f"q{k}") for k, n in enumerate(features)]).first()
    return [np.unique(np.array(q, float)) if q else np.zeros(0) for q in found]


def _margins(r: dict, x: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Margin of each row by all trees since they were last written down, and its node in the last tree."""
    margin = np.frombuffer(r["margin"]).copy()
    feature, cut, value = (np.asarray(r[k]).reshape(-1, nodes) for k in ("feature", "cut", "value"))
    node = np.zeros(len(x), np.int64)
    for f, b, v in zip(feature, cut, value):
        node = walk(x, f, b)
        margin += v[node]
    return margin, node


def fit_boosted(rows: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label", weight: str | None = None,
                id: str = "id", plan: Boosting = Boosting()) -> tuple[DataFrame, list[np.ndarray]]:
    """One row for each key with all its trees, and the cuts of the features.

    Trees are flat arrays ``feature``, ``cut`` (rows with a bin beyond it go right) and ``value`` of ``plan.nodes`` nodes each;
    labels are 0 and 1, and rows with a null are left out.  ``id`` names the column whose hash decides which trees see a row.
    """
    keys, d = list(keys), len(features)
    used = rows.select(*keys, *[c(n).cast("double").alias(f"_x{k}") for k, n in enumerate(features)], c(label).cast("double").alias("_y"),
                       (c(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), F.xxhash64(id).alias("_mark")).dropna()
    used = saved(used, "boosting-rows")
    cuts = quantile_cuts(used, [f"_x{k}" for k in range(d)], plan.bins)
    kinds = dict(used.dtypes)
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, part in batch.groupby(keys, sort=False):
                for at in range(0, len(part), BLOCK_ROWS):
                    cut = part.iloc[at : at + BLOCK_ROWS]
                    x = np.column_stack([np.searchsorted(cuts[k], cut[f"_x{k}"].to_numpy()).astype(np.uint8) for k in range(d)])
                    out.append((*key, x.tobytes(), cut["_y"].to_numpy().tobytes(), cut["_w"].to_numpy().tobytes(), cut["_mark"].to_numpy().tobytes(), np.zeros(len(cut)).tobytes()))
            yield pd.DataFrame(out, columns=[*keys, "x", "y", "w", "marks", "margin"])

    block_schema = f"{key_schema}, x binary, y binary, w binary, marks binary, margin binary"
    blocks = saved(used.mapInPandas(blocks_of, block_schema), "boosting-blocks")
    empty = {"feature": "array<int>", "cut": "array<int>", "value": "array<double>"}
    state = saved(blocks.select(*keys).distinct().select(*keys, *[F.array().cast(t).alias(n) for n, t in empty.items()]), "trees")
    few = state.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    state_schema = f"{key_schema}, feature array<int>, cut array<int>, value array<double>"
    grown: list[DataFrame] = []

    def with_trees() -> DataFrame:
        return blocks.join(F.broadcast(state) if few else state, keys)

    for t in range(plan.rounds):
        columns = plan.features(t, d)
        for level in range(plan.depth):

            def vector(r: dict, level=level, t=t, columns=columns) -> np.ndarray:
                y, w = np.frombuffer(r["y"]), np.frombuffer(r["w"])
                x = np.frombuffer(r["x"], np.uint8).reshape(len(y), -1)
                margin, node = _margins(r, x, plan.nodes)
                if level == 0:
                    node = np.zeros(len(y), np.int64)
                elif len(r["value"]):  # the margin without the tree that is growing
                    margin -= np.asarray(r["value"])[-plan.nodes :][node]
                return sums_of_level(x, y, w * plan.drawn(t, np.frombuffer(r["marks"], np.int64)), margin, node, level, columns, plan.bins)

            def split(batches: Iterator[pd.DataFrame], level=level, columns=columns) -> Iterator[pd.DataFrame]:
                for b in batches:
                    out = []
                    for r in b.to_dict("records"):
                        feature, cut, value = (np.array(r[k]) for k in ("feature", "cut", "value"))
                        if level == 0:
                            feature = np.append(feature, np.full(plan.nodes, -1)).astype(int)
                            cut, value = np.append(cut, np.zeros(plan.nodes)).astype(int), np.append(value, np.zeros(plan.nodes))
                        at = len(feature) - plan.nodes
                        for node, f, k, left, right in best_splits(np.asarray(r["sums"]), level, d, columns, plan):
                            feature[at + node], cut[at + node] = f, k
                            value[at + 2 * node + 1], value[at + 2 * node + 2] = left, right
                        out.append((*[r[k] for k in keys], feature, cut, value))
                    yield pd.DataFrame(out, columns=[*keys, "feature", "cut", "value"])

            sums = keyed_sums(with_trees(), keys, vector)
            state = saved(state.join(F.broadcast(sums) if few else sums, keys).mapInPandas(split, state_schema), "trees")
        if (t + 1) % WRITTEN_AFTER == 0 and t + 1 < plan.rounds:

            def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    b["margin"] = [_margins(r, np.frombuffer(r["x"], np.uint8).reshape(len(np.frombuffer(r["y"])), -1), plan.nodes)[0].tobytes() for r in b.to_dict("records")]
                    yield b[[*keys, "x", "y", "w", "marks", "margin"]]

            grown.append(state)
            blocks = saved(with_trees().mapInPandas(written, block_schema), "boosting-blocks")
            state = saved(state.select(*keys, *[F.array().cast(k).alias(n) for n, k in empty.items()]), "trees")
    grown.append(state)
    whole = None
    for k, part in enumerate(grown):  # one part for each WRITTEN_AFTER trees
        one = part.withColumn("_part", F.lit(k))
        whole = one if whole is None else whole.unionByName(one)
    ordered = F.array_sort(F.collect_list(F.struct("_part", *empty)))
    models = whole.groupBy(*keys).agg(ordered.alias("_all"))

    def trees(name: str) -> Column:
        return F.flatten(F.transform("_all", lambda p: p[name])).alias(name)

    return saved(models.select(*keys, *map(trees, empty)), "boosted"), cuts


def score_boosted(rows: DataFrame, models: DataFrame, cuts: list[np.ndarray], keys: Sequence[str], features: Sequence[str], out: str = "prob_up",
                  plan: Boosting = Boosting()) -> DataFrame:
    """Add the probability of class 1; null where a feature is, or the key has no model.

    Rows meet the trees of their key in blocks, so a model is copied once for a block and not for a row.
    """
    keys = list(keys)
    x = F.array(*[c(n).cast("double") for n in features])
    block = F.pmod(F.xxhash64(*[c(n) for n in features]), F.ceil(F.lit(1.0) * c("_n") / BLOCK_ROWS)).cast("int")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    few = models.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    sizes, table = (F.broadcast(sizes), F.broadcast(models)) if few else (sizes, models)
    packed = rows.join(sizes, keys).withColumn("_block", block).groupBy(*keys, "_block").agg(F.collect_list(F.struct(F.struct(*rows.columns).alias("row"), x.alias("x"))).alias("_rows"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def probabilities(xs: pd.Series, feature: pd.Series, cut: pd.Series, value: pd.Series) -> pd.Series:
        found = []
        for one, f, b, v in zip(xs, feature, cut, value):
            raw = np.array([np.asarray(r, float) for r in one])
            known = ~np.isnan(raw).any(axis=1)
            at = np.column_stack([np.searchsorted(cuts[k], raw[:, k]) for k in range(raw.shape[1])])
            margin = np.zeros(len(raw))
            if f is None:
                found.append([None] * len(raw))
                continue
            for tf, tb, tv in zip(*(np.asarray(a).reshape(-1, plan.nodes) for a in (f, b, v))):
                margin += tv[walk(at, tf, tb)]
            found.append([p if k else None for p, k in zip((1 / (1 + np.exp(-margin))).tolist(), known)])
        return pd.Series(found)

    met = packed.join(table, keys, "left")
    met = met.withColumn("_p", probabilities(F.transform("_rows", lambda r: r["x"]), "feature", "cut", "value"))
    flat = met.select(F.inline(F.arrays_zip(F.transform("_rows", lambda r: r["row"]).alias("row"), F.col("_p").alias("p"))))
    return flat.select("row.*", F.col("p").alias(out))
