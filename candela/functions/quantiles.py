"""Exact percentiles that never hold a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.durable import materialize, saved
from candela.functions.keytables import per_key
from candela.functions.series import Series, index, running

ACCURACY = 50000
#: Distinct values in a cell that one task sorts, and quantiles up to which a table of them is broadcast.
CELL_VALUES, FEW_CUTS = 1 << 16, 2_000_000


def _bracket_counts(rows: DataFrame, keys: list[str], asked: DataFrame | None, probs: list[float], accuracy: int, slack: float) -> DataFrame:
    """Counts of the rows below, above and, by value, inside the bracket of each percentile."""
    if slack < 1:
        ends = [F.array(*[F.lit(min(1.0, max(0.0, p + s))) for p in probs]) for s in (-slack, slack)]
        ends = [F.percentile_approx("_v", e, accuracy) for e in ends]
    else:
        ends = [F.array_repeat(f("_v"), len(probs)) for f in (F.min, F.max)]
    sketch = rows.groupBy(*keys).agg(ends[0].alias("_lo"), ends[1].alias("_hi"), F.count(F.lit(1)).alias("_n"))
    of_prob = F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), F.col("_lo"), F.col("_hi")))
    brackets = sketch.select(*keys, "_n", of_prob.alias("_b")).select(
        *keys, "_n", F.col("_b.p").alias("prob"), F.col("_b._lo").alias("_lo"), F.col("_b._hi").alias("_hi")
    )
    if asked is not None:
        brackets = brackets.join(asked, [*keys, "prob"], "left_semi")
    joined = rows.join(per_key(brackets), keys) if keys else rows.crossJoin(F.broadcast(brackets))
    # rows outside the bracket collapse into one entry per side that keeps its nearest value
    v, side = F.col("_v"), F.col("_side")
    marked = joined.withColumn("_side", F.when(v < F.col("_lo"), -1).when(v > F.col("_hi"), 1).otherwise(0))
    counted = marked.groupBy(*keys, "prob", "_n", "_side", F.when(side == 0, v).alias("_in")).agg(
        F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_top"), F.min("_v").alias("_bottom")
    ).withColumn("_v", F.when(side == -1, F.col("_top")).otherwise(F.col("_bottom")))
    return saved(counted.select(*keys, "prob", "_n", "_side", "_c", "_v"), "bracket-counts")


def _missed(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The percentiles whose rank lies outside their bracket and is not the value next to it either."""
    rank, sure = (F.col("_n") - 1) * F.col("prob"), F.col("_below") + F.col("_inside")
    at = [F.coalesce(F.sum(F.when(F.col("_side") == k, F.col("_c"))), F.lit(0)) for k in (-1, 0)]
    return counted.groupBy(*keys, "prob", "_n").agg(at[0].alias("_below"), at[1].alias("_inside")).where(
        (F.floor(rank) < F.col("_below") - 1) | (F.ceil(rank) > sure)
    ).select(*keys, "prob")


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = ACCURACY, slack: float | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per key: columns ``keys, prob, value``.

    A sketch brackets each percentile.  One aggregation then counts the rows
    below the bracket and the distinct values inside it, and only the latter
    (about 1/8000 of the rows) are sorted.  The counts show whether a bracket
    holds its rank; those that do not are widened, 64 times each round and at
    last to all values, and counted again, so no answer rests on the sketch.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    probs = [float(p) for p in probs]
    slack = 3.0 / accuracy if slack is None else slack
    held, asked = None, None
    while True:
        counted = _bracket_counts(rows, keys, asked, probs, accuracy, slack)
        if slack < 1:
            asked = saved(_missed(counted, keys), "missed")
            done = asked.isEmpty()
        else:
            done = True
        fit = counted if done else counted.join(asked, [*keys, "prob"], "left_anti")
        held = fit if held is None else held.unionByName(fit)
        if done:
            break
        if keys:
            rows = rows.join(per_key(asked.select(*keys).distinct()), keys, "left_semi")
        slack = min(1.0, slack * 64)
    v = F.col("_v")
    up_to = Window.partitionBy(*keys, "prob").orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("_cum", F.sum("_c").over(up_to)).withColumn("_rank", (F.col("_n") - 1) * F.col("prob"))
    at_floor = F.min(F.when(F.col("_cum") > F.floor("_rank"), v))
    at_ceil = F.min(F.when(F.col("_cum") > F.ceil("_rank"), v))
    return (
        ranked.groupBy(*keys, "prob")
        .agg(at_floor.alias("_a"), at_ceil.alias("_z"), F.first("_rank").alias("_rank"))
        .select(
            *keys,
            "prob",
            (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))).alias("value"),
        )
    )


def running_by_value(
    df: DataFrame, keys: list[str], value: str, aggs: dict[str, Column], own: bool = False, cell_values: int = CELL_VALUES
) -> DataFrame:
    """Distinct values per key with running totals of counts up to each value.

    Equal values collapse before anything is sorted.  Saved approximate
    quantiles cut the distinct values into cells of similar size, as many as
    the counted values of the largest key need at ``cell_values`` each, so no
    task sorts a whole key.  ``own`` also keeps the totals of the value itself.
    """
    x = F.col(value).cast("double").alias("_x")
    per_value = materialize(df.select(*df.columns, x).groupBy(*keys, "_x").agg(*[a.alias(f"{n}_here") for n, a in aggs.items()]))
    most = per_value.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0  # one number
    cells = max(256, 1 << (most // cell_values).bit_length())
    # one literal, however many cells there are
    probs = F.split(F.lit(",".join(str(i / cells) for i in range(1, cells))), ",").cast("array<double>")
    cuts = materialize(per_value.groupBy(*keys).agg(F.percentile_approx("_x", probs, 4 * cells).alias("_cuts")))
    # the cell of a value is the number of cuts below it, found by halving
    steps = F.array(*[F.lit(2**i) for i in reversed(range((cells - 1).bit_length()))])
    reach = lambda at, step: F.get("_cuts", at + step - 1) < F.col("_x")
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(reach(at, step), step).otherwise(0))
    with_cuts = per_value.join(per_key(cuts, FEW_CUTS // cells), keys) if keys else per_value.crossJoin(F.broadcast(cuts))
    celled = with_cuts.withColumn("_cut", below).drop("_cuts")
    group = list(keys) or ["_all"]
    celled = celled if keys else celled.withColumn("_all", F.lit(0))
    series = Series(tuple(group), ("_x",), lambda: [F.col("_cut")])
    done = running(index(celled, series), series, {n: ("sum", F.col(f"{n}_here")) for n in aggs})
    here = [f"{n}_here" for n in aggs] if own else []
    return done.select(*keys, F.col("_x").alias(value), *aggs, *here)
