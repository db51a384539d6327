"""Saved tables, lookups that stand hot keys, and ranks without one task per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.durable import scratch_path

#: White space of all word rules here: space, and tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Keys with one in so many rows or more are hot, so there are never more hot keys than this.
HOT_KEYS = 1024
#: A group below this size is never worth splitting.
SMALL_GROUP = 64
#: Rows that one task of a rank sorts together, on average.
CELL_ROWS = 4096


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: computed once, and safe when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_size(total: int) -> int:
    """Rows from which a key counts as hot: at most HOT_KEYS keys of a table of ``total`` rows can have as many."""
    return max(SMALL_GROUP, -(-total // HOT_KEYS))


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """The keys with hot_size(total) rows or more, HOT_KEYS at most."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_size(total)).select(key)


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row of a fixed size for each key.

    ``hot`` names at most HOT_KEYS keys.  Their rows are answered from a broadcast of that bound and then leave
    the key, dealt out by ``spread``, so that the join of the others meets no hot key.
    """
    values = [c for c in table.columns if c != key]
    head = table.join(F.broadcast(hot.select(key)), key, "left_semi").select(key, F.struct(*values).alias("_hot"))
    marked = rows.join(F.broadcast(head), key, "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long"))
    )
    rest = table.select(F.col(key), F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_cold"))
    joined = marked.join(rest, [key, "_salt"], "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*rows.columns, *[found[v].alias(v) for v in values])


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, spread: Sequence[str], how: str = "inner") -> DataFrame:
    """Join, inner or left, of ``rows`` with ``table``, which has one row of any size for each key.

    ``hot`` (key, n) names at most HOT_KEYS keys with their counts in ``rows``.  Only these names are broadcast; the
    table row of a hot key is repeated for every SMALL_GROUP rows, and the rows are dealt out to the repeats.
    """
    names = F.broadcast(hot.select(key, F.ceil(F.col("n") / SMALL_GROUP).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = rows.join(names, key, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    repeats = table.join(names, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(repeats, [key, "_part"], how).drop("_part")


def ranked(df: DataFrame, key: str, order: Sequence[str], total: int) -> DataFrame:
    """``df`` with ``rank``: the 0-based place of each row among those of its key, in an order fixed by ``order``.

    Rows of a key are cut into hashed cells of about CELL_ROWS rows; a rank is the count of the cells before plus
    the place in the own cell, so no task sorts a whole key.
    """
    cells = max(1, total // CELL_ROWS)
    cut = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_start"))
    )
    inside = Window.partitionBy(key, "_cell").orderBy(*order)
    return (
        cut.withColumn("_place", F.row_number().over(inside) - 1).join(starts, [key, "_cell"])
        .withColumn("rank", (F.col("_place") + F.col("_start")).cast("long")).drop("_cell", "_place", "_start")
    )


def normal_text(text: Column) -> Column:
    """Null as empty, and each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
