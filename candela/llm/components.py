"""Connected components of an edge table, by hooking to smaller neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.llm.frames import hot_keys, lookup, saved


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, up) with up < node, one row for each node, to (node, up) with every up a root: pointer doubling."""
    while True:
        total = hooks.count()
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
        step = lookup(hooks, above, "up", hot_keys(hooks, "up", total), ["node"])
        step = saved(step.select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
        hooks = step.select("node", "up")
        if step.where("moved").limit(1).count() == 0:
            return hooks


def _renamed(df: DataFrame, column: str, names: DataFrame, spread: list[str]) -> DataFrame:
    """``column`` replaced by its root, where it has one."""
    table = names.select(F.col("node").alias(column), F.col("up").alias("_up"))
    found = lookup(df, table, column, hot_keys(df, column, df.count()), spread)
    return found.withColumn(column, F.coalesce("_up", column)).drop("_up")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any ordered type to (node, root) for every node that has an edge; root is the smallest.

    Each round, every node hooks to its smallest smaller neighbour, trees are flattened by pointer doubling, and
    the edges are renamed to the roots; edges inside a tree go.  Every node with a smaller neighbour stops being a
    root, so a round leaves only the nodes that are smaller than all their neighbours.  Links and labels stay in
    tables; only counts reach the driver.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = saved(pairs.distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.col("node").alias("up"))
    while left.limit(1).count():
        hooks = saved(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")), "hooks")
        roots = _roots(hooks)
        labels = saved(_renamed(labels, "up", roots, ["node"]), "labels")
        left = _renamed(left, "a", roots, ["a", "b"])
        left = _renamed(saved(left, "edges"), "b", roots, ["a", "b"])
        left = saved(
            left.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
        )
    return labels.select("node", F.col("up").alias("root"))
