"""Views of the given tables as bars, trades and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.durable import saved
from candela.functions.keytables import per_key
from candela.functions.series import Series
from candela.sources.bars import ticks_to_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, granularity: str = "H1") -> DataFrame:
    """Bars per event type: price is the event value, volume the event count."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return ticks_to_bars(events, "event_type", "ts", "value", granularity, tie="event_id")


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per return flag: price per unit of each shipped line, volume the line count."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    tie = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ticks_to_bars(lines, "l_returnflag", "l_shipdate", "price", "D", tie=tie)


TRADE_TIE = ("order_key", "line_no", "part_key", "supp_key", "notional")


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades out of order lines: instrument is the part's brand, exit the shipping date."""
    return _trades_with_margin(spark, sf_dir).drop("margin")


def ordered(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """``lines`` joined with ``orders`` of which no column is asked for: each line once for every order of its key.

    Only keys are shuffled for it.  Those that have not just one order are then joined with the lines, by broadcast if
    they are counted to be few.
    """
    lines = lines.where(F.col("l_orderkey").isNotNull())
    counts = orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("_orders"))
    held = lines.select("l_orderkey").distinct().join(counts, "l_orderkey", "left").withColumn("_orders", F.coalesce("_orders", F.lit(0)))
    odd = per_key(held.where("_orders != 1"))
    times = F.array_repeat(F.lit(1), F.coalesce("_orders", F.lit(1)).cast("int"))
    return lines.join(odd, "l_orderkey", "left").withColumn("_orders", F.explode(times)).drop("_orders")


def _trades_with_margin(spark: SparkSession, sf_dir: str, entry: bool = True) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        (F.col("l_discount") - F.col("l_tax")).alias("margin"), "l_returnflag", "l_linestatus", "l_shipdate",
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    if entry:
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    else:
        lines = ordered(lines, orders)
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)")
        ).alias("trade_id"),
        F.col("p_brand").alias("instrument"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("direction"),
        *([F.col("o_orderdate").alias("entry_time")] if entry else []),
        F.col("l_shipdate").alias("exit_time"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_extendedprice") * F.col("margin")).alias("pnl"),
        (100 * F.col("margin")).alias("pnl_percent"),
        F.col("l_returnflag").alias("strategy"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_extendedprice").alias("notional"),
        "margin",
    )


def pnl_trades(spark: SparkSession, sf_dir: str, entry: bool = True) -> DataFrame:
    """The columns of the trades that pnl and health figures read, saved: each of their passes would join the lines again.

    The margin has few values; pnl and pnl_percent are made of it again after reading.  Without ``entry`` there is no
    entry_time, the one column of an order, and the lines need not be shuffled by order.
    """
    need = dict.fromkeys(["instrument", *(["entry_time"] if entry else []), "exit_time", *TRADE_TIE, "margin"])
    kept = saved(_trades_with_margin(spark, sf_dir, entry).select(*need), "trades")
    gains = {"pnl": F.col("notional") * F.col("margin"), "pnl_percent": 100 * F.col("margin")}
    return kept.withColumns(gains).drop("margin")


def trade_series(keys=("instrument",), chunk_rows: int = 131072) -> Series:
    """Trades by exit time.

    A cell is one day and a block of four million order keys, which bounds its
    rows.  Chunks are large, because trades only need short frames and sums.
    """
    def cells():
        return [
            F.expr("datediff(to_date(exit_time), DATE'1970-01-01')"),
            F.expr("order_key div 4194304"),
        ]

    return Series(tuple(keys), ("exit_time", *TRADE_TIE), cells, chunk_rows)


def embedding_features(spark: SparkSession, sf_dir: str, width: int = 64) -> DataFrame:
    """The embedding table as numeric feature columns ``f0 .. f{width-1}``."""
    vec = table(spark, sf_dir, "embeddings")
    return vec.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(width)])
