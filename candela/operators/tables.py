"""Filters, slices, repairs and set operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.keytables import per_key
from candela.functions.guards import c, clean
from candela.functions.series import CHUNK, RN, Series, index, running, strip


def between(df: DataFrame, ts: str, start=None, end=None, include_end: bool = True) -> DataFrame:
    """Rows from ``start`` to ``end``; the predicate reaches the scan."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        limit = F.lit(end).cast("timestamp_ntz")
        df = df.where(F.col(ts) <= limit if include_end else F.col(ts) < limit)
    return df


def positions(df: DataFrame, series: Series, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows ``start`` to ``stop`` of each series, counted as in a slice: from 0, negative from the end."""
    at = c(RN) - 1
    numbered = index(df, series)
    if start < 0 or (stop is not None and stop < 0):
        lengths = per_key(df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("_len")))
        numbered = numbered.join(lengths, list(series.keys))
    bound = lambda i: F.lit(i) if i >= 0 else c("_len") + i
    keep = at >= bound(start)
    if stop is not None:
        keep = keep & (at < bound(stop))
    return strip(numbered.where(keep)).drop("_len")


def fill_gaps(df: DataFrame, series: Series, columns: list[str]) -> DataFrame:
    """Infinities become null; nulls take the last known value, else the next one; rows still null are dropped.

    Both directions use one partial result per chunk, so any gap length is right.
    """
    df = index(df.withColumns({n: clean(n) for n in columns}), series)
    df = running(df, series, {f"_f_{n}": ("last", c(n)) for n in columns})
    # backwards: the first non-null value of the chunk's rest, else of the chunks after it
    keys = list(series.keys)
    firsts = df.groupBy(*keys, CHUNK).agg(
        *[F.min_by(n, F.when(c(n).isNotNull(), c(RN))).alias(f"_h_{n}") for n in columns]
    )
    after = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(1, Window.unboundedFollowing)
    nexts = firsts.select(*keys, CHUNK, *[F.first(f"_h_{n}", True).over(after).alias(f"_n_{n}") for n in columns])
    rest = Window.partitionBy(*keys, CHUNK).orderBy(RN).rowsBetween(0, Window.unboundedFollowing)
    df = df.join(nexts, [*keys, CHUNK], "left").withColumns(
        {n: F.coalesce(c(f"_f_{n}"), F.first(n, True).over(rest), c(f"_n_{n}")) for n in columns}
    )
    df = df.drop(*[f"{p}{n}" for n in columns for p in ("_f_", "_n_")])
    return strip(df.dropna(subset=columns))


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(clean(n), F.lit(0.0)) for n in columns})


def filter_ledger(trades: DataFrame, instrument="All", direction="All", strategy="All") -> DataFrame:
    for name, value in (("instrument", instrument), ("direction", direction), ("strategy", strategy)):
        if value != "All":
            trades = trades.where(F.col(name) == value)
    return trades


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def signed_money(column: str) -> Column:
    x = c(column)
    return F.concat(F.when(x >= 0, "+").otherwise("-"), F.lit("$"), _half_up(F.abs(x), 2))


def percent(column: str, digits: int = 2) -> Column:
    return F.concat(_half_up(c(column), digits), F.lit("%"))


def _half_up(x: Column, digits: int) -> Column:
    """Text of the number rounded as a decimal, so that halves go up and not where the binary number happens to lie."""
    return F.round(x.cast("decimal(28,6)"), digits).cast("string")


def display_ledger(trades: DataFrame) -> DataFrame:
    """Ledger with pnl and percent as text."""
    return trades.withColumns({"pnl_text": signed_money("pnl"), "pnl_percent_text": percent("pnl_percent")})


def features_with_target(features: DataFrame, targets: DataFrame, on=("symbol", "ts"), target: str = "target") -> DataFrame:
    """Rows that exist on both sides and have a target."""
    return features.join(targets.select(*on, target), list(on)).where(F.col(target).isNotNull())


def upsert(old: DataFrame, new: DataFrame, key: str, arrival: str) -> DataFrame:
    """Latest version per key of old and new rows.

    A rank of 1 per key: Spark keeps one candidate per key and task before the shuffle.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(arrival))
    both = old.unionByName(new)
    return both.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def remove(df: DataFrame, closed: DataFrame, key: str) -> DataFrame:
    return df.join(closed.select(key).distinct(), key, "left_anti")


def recent(df: DataFrame, ts: str, as_of: str, span: str) -> DataFrame:
    """Rows of the last ``span`` (such as ``30 DAYS``) before ``as_of``, newest first."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where((F.col(ts) >= end - F.expr(f"INTERVAL {span}")) & (F.col(ts) <= end)).orderBy(F.desc(ts))
