"""Ordered-series machinery: window functions that scale past one task per key.

A window partitioned by a series key alone puts the whole series in one task.
Here every row first gets its dense position in the series, then positions are
cut into chunks of a fixed number of rows.  A chunk also receives copies of the
few rows before (lookback) and after (lookahead) it, so frames of a known
length are exact although the task only ever sees one bounded chunk.

Running aggregates that need the whole past use one partial result per chunk,
a window over those partials, and a window inside the chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.durable import materialize

RN, CHUNK, BLOCK, OWN, BEFORE = "_rn", "_chunk", "_block", "_own", "_before"
#: Exponential means: output name to (column, span).
Means = dict[str, tuple[str, int]]
BLOCK_ROWS = 512
# with a lookback of 1,024 rows a chunk still fits the 4,096 rows that Spark's window operator keeps as plain rows
CHUNK_ROWS = 3072
HELPERS = (RN, CHUNK, BLOCK, OWN)


def day_cells(column: str, days: int) -> Callable[[], list[Column]]:
    """Coarse time cells of ``days`` calendar days, in time order."""
    return lambda: [F.expr(f"datediff(to_date(`{column}`), DATE'1970-01-01') div {int(days)}")]


@dataclass(frozen=True)
class Series:
    """What makes rows one ordered series.

    ``keys`` name the series, ``order`` sorts it totally.  ``cell`` gives
    columns that are monotone in the order and bound how many rows share one
    value; positions are numbered inside a cell and shifted by the row counts
    of the cells before it.  Several cell columns form levels (day, block of
    keys), so that no level has many cells under one parent.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)
    cell: Callable[[], list[Column]] = field(default_factory=lambda: day_cells("ts", 170))
    chunk_rows: int = CHUNK_ROWS

    def __post_init__(self):
        if self.chunk_rows % BLOCK_ROWS:
            raise ValueError(f"chunk_rows must be a multiple of {BLOCK_ROWS}")


def bar_series(bar_seconds: int = 3600, keys=("symbol",), ts: str = "ts", chunk_rows: int = CHUNK_ROWS) -> Series:
    """Series of bars.  A cell spans about 4096 bar slots, so it holds at most that many rows."""
    days = max(1, 4096 * bar_seconds // 86400)
    return Series(tuple(keys), (ts,), day_cells(ts, days), chunk_rows)


def index(df: DataFrame, series: Series) -> DataFrame:
    """Add the 1-based position of each row in its series (``_rn``) and its chunk."""
    cells = series.cell()
    names = [f"_cell{i}" for i in range(len(cells))]
    keys = list(series.keys)
    celled = df.withColumns(dict(zip(names, cells)))
    counts = celled.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    # rows before a cell: those of earlier cells at its own level, plus those before its parent
    parents = [*keys, *names[:-1]]
    before = Window.partitionBy(*parents).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    bases = counts.select(*keys, *names, F.coalesce(F.sum("_n").over(before), zero).alias("_base"))
    for depth in range(len(names) - 1, 0, -1):
        level = [*keys, *names[:depth]]
        up = Window.partitionBy(*level[:-1]).orderBy(level[-1]).rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.groupBy(*level).agg(F.sum("_n").alias("_n"))
        above = sums.select(*level, F.coalesce(F.sum("_n").over(up), zero).alias("_above"))
        bases = bases.join(above, level).withColumn("_base", F.col("_base") + F.col("_above")).drop("_above")
    inside = Window.partitionBy(*keys, *names).orderBy(*series.order)
    return (
        celled.join(bases, [*keys, *names])
        .withColumn(RN, F.col("_base") + F.row_number().over(inside))
        .withColumn(CHUNK, F.expr(f"({RN} - 1) div {series.chunk_rows}"))
        .withColumn(BLOCK, F.expr(f"({RN} - 1) div {BLOCK_ROWS}"))
        .drop("_base", *names)
    )


def spread(indexed: DataFrame, series: Series, lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Copy the rows that neighbouring chunks need into those chunks; ``_own`` marks the originals."""
    if not lookback and not lookahead:
        return indexed.withColumn(OWN, F.lit(True))
    size = series.chunk_rows
    back = -(-lookback // BLOCK_ROWS) * BLOCK_ROWS
    own = F.col(CHUNK)
    first = F.greatest(F.lit(0), F.floor((F.col(RN) - 1 - lookahead) / size))
    last = F.floor((F.col(RN) - 1 + back) / size)
    copied = (
        indexed.withColumn("_home", own)
        .withColumn(CHUNK, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn(OWN, F.col(CHUNK) == F.col("_home"))
        .drop("_home")
    )
    # the shuffle the windows need anyway, but with a fixed number of partitions: windows cost
    # far more than their bytes suggest, so merging small partitions by size would leave cores idle
    n = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copied.repartition(n, *series.keys, CHUNK)


def numbered(df: DataFrame, series: Series, position: str) -> DataFrame:
    """Take the positions from a column that already holds them, instead of counting again."""
    return df.withColumns(
        {
            RN: F.col(position),
            CHUNK: F.expr(f"({position} - 1) div {series.chunk_rows}"),
            BLOCK: F.expr(f"({position} - 1) div {BLOCK_ROWS}"),
        }
    )


def own(df: DataFrame) -> DataFrame:
    """Drop the copies made by :func:`spread`."""
    return df.where(F.col(OWN))


def strip(df: DataFrame) -> DataFrame:
    """Drop copies and helper columns."""
    return (df.where(F.col(OWN)) if OWN in df.columns else df).drop(*HELPERS)


class Frame:
    """Window expressions inside one chunk of a series."""

    def __init__(self, series: Series):
        self.keys = list(series.keys)
        self.w = Window.partitionBy(*self.keys, CHUNK).orderBy(BLOCK, RN)
        self.in_block = Window.partitionBy(*self.keys, CHUNK, BLOCK).orderBy(RN)

    def rows(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def full(self, column, n: int, agg: Callable[..., Column] = F.avg) -> Column:
        """``agg`` over the last ``n`` rows, null until ``n`` non-null values are there."""
        return self.at_least(column, n, n, agg)

    def at_least(self, column, n: int, need: int, agg: Callable[..., Column] = F.avg) -> Column:
        r = self.rows(n)
        return F.when(F.count(column).over(r) >= need, agg(column).over(r))

    def lag(self, column, k: int = 1) -> Column:
        return F.lag(column, k).over(self.w)

    def lead(self, column, k: int = 1) -> Column:
        return F.lead(column, k).over(self.w)

    # Exponential means ``{output: (column, span)}``, seeded with the first value.
    # A step of the recursion is affine, so the mean at a row is the decayed mean at
    # the end of the block before (see :func:`block_means`) plus a weighted sum inside
    # the block.  The cost per row does not grow with the span, and no history is cut.

    def ema_sums(self, specs: Means) -> dict[str, Column]:
        upto = self.in_block.rowsBetween(Window.unboundedPreceding, 0)
        out = {}
        for name, (column, span) in specs.items():
            alpha, growth = 2.0 / (span + 1), (span + 1) / (span - 1.0)
            out[f"_ema_s_{name}"] = F.sum(_seeded(column, alpha) * F.pow(F.lit(growth), _in_block())).over(upto) * alpha
        return out

    def ema_values(self, specs: Means) -> dict[str, Column]:
        before = F.element_at(F.col(BEFORE), F.col(BLOCK))
        out = {}
        for name, (_, span) in specs.items():
            d = _decay(span)
            carried = F.coalesce(before[name], F.lit(0.0)) * d
            out[name] = F.pow(F.lit(d), _in_block()) * (F.col(f"_ema_s_{name}") + carried)
        return out


def _seeded(column: str, alpha: float) -> Column:
    """Values of the recursion; the first value of a series stands for all before it."""
    return F.when(F.col(RN) == 1, F.col(column) / alpha).otherwise(F.col(column))


def block_means(indexed: DataFrame, series: Series, specs: Means, lookback: int, lookahead: int) -> DataFrame:
    """Keys, chunk and ``BEFORE``: the exponential means at the end of the block before each block of the chunk's window.

    One aggregation gives what each block adds to the mean at its end.  The mean before a block is the decayed sum of
    these over the blocks before it; blocks so far back that their weight is zero as a double are left out.
    """
    keys, size = list(series.keys), series.chunk_rows
    ends = {}
    for name, (column, span) in specs.items():
        alpha = 2.0 / (span + 1)
        weight = F.pow(F.lit(_decay(span)), F.lit(BLOCK_ROWS - 1) - _in_block())
        ends[name] = F.sum(_seeded(column, alpha) * weight) * alpha
    blocks = indexed.groupBy(*keys, BLOCK).agg(*[F.coalesce(v, F.lit(0.0)).alias(f"_end_{n}") for n, v in ends.items()])
    reach = max(_blocks_until_zero(span) for _, span in specs.values())
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(-reach, -1)
    means = [
        F.aggregate(F.collect_list(f"_end_{n}").over(earlier), F.lit(0.0), _decaying(F.lit(_decay(span) ** BLOCK_ROWS))).alias(n)
        for n, (_, span) in specs.items()
    ]
    back = -(-lookback // BLOCK_ROWS) * BLOCK_ROWS
    start = F.col(BLOCK) * BLOCK_ROWS
    first = F.greatest(F.lit(0), F.floor((start - lookahead) / size)).cast("long")
    last = F.floor((start + BLOCK_ROWS - 1 + back) / size).cast("long")
    spread_ = blocks.select(*keys, BLOCK, F.struct(*means).alias("_m")).withColumn(CHUNK, F.explode(F.sequence(first, last)))
    return spread_.groupBy(*keys, CHUNK).agg(F.map_from_entries(F.collect_list(F.struct(BLOCK, "_m"))).alias(BEFORE))


def _blocks_until_zero(span: int) -> int:
    """Blocks after which the weight of a value is zero as a double."""
    return math.ceil(746 / (-math.log(_decay(span)) * BLOCK_ROWS)) + 1


def middle(sorted_values: str, need: int) -> Column:
    """Median of a sorted array once it has ``need`` values."""
    size = F.size(sorted_values)
    low, high = F.get(sorted_values, F.floor((size - 1) / 2)), F.get(sorted_values, F.floor(size / 2))
    return F.when(size >= need, (low + high) / 2)


def _in_block() -> Column:
    return F.col(RN) - 1 - F.col(BLOCK) * BLOCK_ROWS


def _decay(span: int) -> float:
    return (span - 1.0) / (span + 1)


def _decaying(factor: Column):
    return lambda total, value: total * factor + value


def on_series(
    df: DataFrame,
    series: Series,
    build: Callable[[DataFrame, Frame], DataFrame],
    lookback: int = 0,
    lookahead: int = 0,
    keep_helpers: bool = False,
    means: Means | None = None,
) -> DataFrame:
    """Run ``build`` over chunked windows of ``df``.

    Rows that already carry positions (from an earlier call with
    ``keep_helpers``) are not numbered again.  ``means`` are exponential means
    of columns of ``df`` that ``build`` takes up from the blocks before.
    """
    indexed = df.drop(OWN) if RN in df.columns else index(df, series)
    rows = spread(indexed, series, lookback, lookahead)
    if means:
        rows = rows.join(block_means(indexed, series, means, lookback, lookahead), [*series.keys, CHUNK], "left")
    built = own(build(rows, Frame(series))).drop(BEFORE)
    return built.drop(OWN) if keep_helpers else built.drop(*HELPERS)


def running(
    df: DataFrame, series: Series, specs: dict[str, tuple[str, Column]], exclusive: bool = False, saved: bool = False
) -> DataFrame:
    """Aggregates over all rows up to the current one: ``{output: (kind, column)}``.

    ``kind`` is ``sum``, ``max``, ``min`` or ``last`` (latest non-null value).
    ``exclusive`` leaves the current row out.  ``df`` must carry positions.  It is
    read twice (for the partial results and for the rows), so it is saved
    first unless the caller says it already is.
    """
    df = df if saved else materialize(df)
    keys = list(series.keys)
    inputs = {f"_in_{n}": c for n, (_, c) in specs.items()}
    df = df.withColumns(inputs)
    part = {"sum": F.sum, "max": F.max, "min": F.min}
    totals = []
    for name, (kind, _) in specs.items():
        c = F.col(f"_in_{name}")
        agg = F.max_by(c, F.when(c.isNotNull(), F.col(RN))) if kind == "last" else part[kind](c)
        totals.append(agg.alias(f"_t_{name}"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carries = df.groupBy(*keys, CHUNK).agg(*totals).select(
        *keys,
        CHUNK,
        *[
            (F.last(f"_t_{n}", True) if kind == "last" else part[kind](f"_t_{n}")).over(before).alias(f"_c_{n}")
            for n, (kind, _) in specs.items()
        ],
    )
    here = Window.partitionBy(*keys, CHUNK).orderBy(BLOCK, RN)
    here = here.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = {}
    for name, (kind, _) in specs.items():
        c, carry = F.col(f"_in_{name}"), F.col(f"_c_{name}")
        if kind == "last":
            out[name] = F.coalesce(F.last(c, True).over(here), carry)
        elif kind == "sum":
            local = F.sum(c).over(here)
            zero = F.lit(0)
            out[name] = F.when(
                local.isNotNull() | carry.isNotNull(), F.coalesce(carry, zero) + F.coalesce(local, zero)
            )
        else:
            both = F.greatest if kind == "max" else F.least
            out[name] = both(part[kind](c).over(here), carry)
    joined = df.join(carries, [*keys, CHUNK], "left").withColumns(out)
    return joined.drop(*inputs, *[f"_c_{n}" for n in specs])
