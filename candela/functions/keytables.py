"""Joins with tables that hold one row per series, feature or instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.functions.durable import materialize

#: Rows up to which a table of keys is broadcast; with a few numbers each, that is some MB.
FEW_ROWS = 100_000


def per_key(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df``, saved, for a join on its keys.

    A handful of keys would send a large table through a handful of tasks, so the small side is broadcast, once its
    counted rows prove that it is small.  With more keys than ``most`` they spread the rows well enough.
    """
    table = materialize(df)
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
